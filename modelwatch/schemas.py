"""Record shapes of the monitoring tables and the default feature contract."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- Fixed values: the feature contract of the public telco customer dataset -------------

NUMERIC_FEATURES = ["SeniorCitizen", "tenure", "MonthlyCharges"]
NULLABLE_NUMERIC_FEATURE = "TotalCharges"
CATEGORICAL_VALUES = {
    "gender": ["Female", "Male"],
    "Partner": ["No", "Yes"],
    "Dependents": ["No", "Yes"],
    "PhoneService": ["No", "Yes"],
    "MultipleLines": ["No", "No phone service", "Yes"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "OnlineSecurity": ["No", "No internet service", "Yes"],
    "OnlineBackup": ["No", "No internet service", "Yes"],
    "DeviceProtection": ["No", "No internet service", "Yes"],
    "TechSupport": ["No", "No internet service", "Yes"],
    "StreamingTV": ["No", "No internet service", "Yes"],
    "StreamingMovies": ["No", "No internet service", "Yes"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaperlessBilling": ["No", "Yes"],
    "PaymentMethod": [
        "Bank transfer (automatic)",
        "Credit card (automatic)",
        "Electronic check",
        "Mailed check",
    ],
}
SPLITS = ["train", "val", "test", "eval_frozen", "excluded"]

# Upper bounds (seconds) of the latency histogram.
LATENCY_BUCKETS = [
    0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.10,
    0.12, 0.14, 0.16, 0.18, 0.20, 0.225, 0.25, 0.5, 1.0, 2.5,
]

# Series watched for drift: the numeric features plus the score, and every categorical
# one; the 0/1 senior flag is watched as a two-level category.
TELCO_MONITORED_NUMERIC = ["tenure", "MonthlyCharges", "TotalCharges", "score"]
TELCO_MONITORED_CATEGORICAL = {**CATEGORICAL_VALUES, "SeniorCitizen": [0, 1]}
# --- End of fixed values -----------------------------------------------------------------


@dataclass(frozen=True)
class FeatureSet:
    """Which columns a model reads. Every operator takes this instead of naming columns."""

    numeric: list[str]
    categorical: dict[str, list]
    nullable_numeric: list[str] = field(default_factory=list)

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.nullable_numeric, *self.categorical]


TELCO = FeatureSet(NUMERIC_FEATURES, CATEGORICAL_VALUES, [NULLABLE_NUMERIC_FEATURE])


def _feature_fields(total_charges: T.DataType, nullable: bool) -> list[T.StructField]:
    return [
        T.StructField("gender", T.StringType(), nullable),
        T.StructField("SeniorCitizen", T.IntegerType(), nullable),
        *[
            T.StructField(name, T.StringType(), nullable)
            for name in CATEGORICAL_VALUES
            if name != "gender"
        ],
        T.StructField("tenure", T.IntegerType(), nullable),
        T.StructField("MonthlyCharges", T.DoubleType(), nullable),
        T.StructField("TotalCharges", total_charges, True),
    ]


RAW_DATASET = T.StructType(
    [
        T.StructField("customerID", T.StringType()),
        *_feature_fields(T.StringType(), True),
        T.StructField("Churn", T.StringType()),
    ]
)

SPLIT_MANIFEST = T.StructType(
    [T.StructField("customerID", T.StringType()), T.StructField("split", T.StringType())]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType(), False),
        *_feature_fields(T.DoubleType(), False),
        T.StructField("prediction", T.StringType(), False),
        T.StructField("threshold", T.DoubleType(), False),
        T.StructField("probability", T.DoubleType(), False),
        T.StructField("model_version", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("event_time", T.TimestampType(), False),
    ]
)

REQUEST_LOG = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("method", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("status_code", T.IntegerType(), False),
        T.StructField("duration_ms", T.DoubleType(), False),
        T.StructField("routing_ms", T.DoubleType()),
        T.StructField("predict_ms", T.DoubleType()),
        T.StructField("insert_ms", T.DoubleType()),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

SERVICE_LOG = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("outcome", T.StringType()),
    ]
)

OUTCOME_LABELS = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("label", T.ShortType(), False),
        T.StructField("available_at", T.TimestampType(), False),
    ]
)

DRIFT_METRICS = T.StructType(
    [
        T.StructField("day", T.DateType(), False),
        T.StructField("feature", T.StringType(), False),
        T.StructField("window_days", T.IntegerType(), False),
        T.StructField("psi", T.DoubleType(), False),
        T.StructField("n_rows", T.LongType(), False),
    ]
)

VERIFICATION_SAMPLE = T.StructType(
    [
        T.StructField("customerID", T.StringType()),
        *_feature_fields(T.StringType(), True),
        T.StructField("expected_score", T.DoubleType()),
    ]
)
