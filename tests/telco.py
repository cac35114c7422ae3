"""A made-up dataset in the shape of the feature contract, for the end-to-end tests."""

import numpy as np

from modelwatch.schemas import CATEGORICAL_VALUES, RAW_DATASET


def raw_rows(n=1500, seed=11):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        tenure = int(rng.integers(0, 73))
        monthly = float(np.round(rng.uniform(20, 120), 2))
        record = {k: str(rng.choice(v)) for k, v in CATEGORICAL_VALUES.items()}
        late = record["Contract"] == "Month-to-month"
        p = 1 / (1 + np.exp(-(1.4 * late + 0.02 * (monthly - 70) - 0.045 * (tenure - 20) - 0.8)))
        record.update(
            customerID=f"C{i:05d}",
            SeniorCitizen=int(rng.random() < 0.2),
            tenure=tenure,
            MonthlyCharges=monthly,
            TotalCharges=" " if tenure == 0 else str(np.round(tenure * monthly, 2)),
            Churn="Yes" if rng.random() < p else "No",
        )
        rows.append(tuple(record[f] for f in RAW_DATASET.names))
    return rows


def raw_frame(spark, n=1500, seed=11):
    return spark.createDataFrame(raw_rows(n, seed), RAW_DATASET)
