"""Column names, value lists and default parameters of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Identity, geography and label columns of a transaction.
KEY_COLUMNS = ["trans_num", "cc_num", "merchant", "unix_time", "is_fraud"]
GEO_COLUMNS = ["cust_lat", "cust_long", "merch_lat", "merch_long"]

# Categorical columns; the second list holds calendar numbers treated as categories in training.
TEXT_CATEGORIES = [
    "IP_Country",
    "MerchantCategory",
    "MerchantCountry",
    "CarrierType",
    "IdentityVerificationStatus",
]
CALENDAR_CATEGORIES = ["IsWeekend", "IsNightTxn", "DayOfWeek", "TransactionHour"]

# Composite risk score weights; device trust counts inverted.
RISK_WEIGHTS = {
    "IPRiskScore": 0.20,
    "EmailRiskScore": 0.15,
    "PhoneRiskScore": 0.10,
    "AddressRiskScore": 0.10,
    "BotLikelihoodScore": 0.20,
    "MerchantRiskScore": 0.10,
    "DeviceTrustScore": 0.10,
    "HistoricalVelocityScore": 0.05,
}

# The derived feature columns in output order, after the key.
DERIVED_FEATURES = [
    "DistanceFromHome",
    "DistanceFromLastTxn",
    "ImpossibleTravelFlag",
    "AmountDeviation_30d",
    "SpendBurstScore",
    "VelocityAcceleration",
    "TimeOfDayDeviation",
    "CategoryDeviationScore",
    "InterArrivalEntropy",
    "MerchantAmountZScore",
    "RiskSignalWeightedScore",
    "NullPwdChange",
    "HasPasswordChange",
    "DaysSincePasswordChangeBucket",
    "DeviceClusterSize",
    "LinkedFraudAccounts",
    "SharedMerchantFraudRate",
    "log_amt",
    "log_DistanceFromHome",
    "log_TimeSinceLastTxn",
    "log_TxnAmount_7d",
    "IsNewDevice_x_IPRisk",
    "IsVPN_x_AmtZScore",
    "Bot_x_Velocity",
]

# 0/1 columns profiled against the label.
BINARY_FLAGS = [
    "IsVPN",
    "IsTor",
    "IsProxy",
    "IPCountryMismatch",
    "IsDisposableEmail",
    "IsVOIP",
    "IsNewDevice",
    "SyntheticIdentityFlag",
    "IsCommercialAddress",
    "IsHighRiskCategory",
    "ImpossibleTravelFlag",
    "PreviousFraudFlag",
    "DeviceBlacklisted",
    "Rule_HighVelocity",
    "Rule_CountryMismatch",
    "Rule_NewDeviceHighAmount",
    "Rule_DisposableEmail",
    "Rule_VPNorTor",
    "Rule_BotLikely",
]

# Trailing velocity windows in seconds, and the window of the amount deviation.
HORIZONS = {"1h": 3_600, "6h": 21_600, "24h": 86_400, "7d": 604_800}
DEVIATION_SECONDS = 2_592_000

# Serving thresholds.
DECLINE_THRESHOLD = 0.8895
REVIEW_THRESHOLD = 0.30
REVIEW_SHARE = 0.6

# Serving input contract, column -> (type, default).
INPUT_CONTRACT = {
    "trans_num": ("string", ""),
    "cc_num": ("long", 0),
    "merchant": ("string", ""),
    "unix_time": ("long", 0),
    "amt": ("double", 0.0),
    "is_fraud": ("int", -1),
}

NULL_CATEGORY = "__NA__"
SENTINEL = -999.0

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("trans_num", T.StringType()),
        T.StructField("cc_num", T.LongType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("unix_time", T.LongType()),
        T.StructField("amt", T.DoubleType()),
        T.StructField("cust_lat", T.DoubleType()),
        T.StructField("cust_long", T.DoubleType()),
        T.StructField("merch_lat", T.DoubleType()),
        T.StructField("merch_long", T.DoubleType()),
        T.StructField("MerchantCategory", T.StringType()),
        T.StructField("is_fraud", T.IntegerType()),
    ]
)

DECISION_SCHEMA = T.StructType(
    [
        T.StructField("trans_num", T.StringType()),
        T.StructField("cc_num", T.LongType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("unix_time", T.LongType()),
        T.StructField("amt", T.DoubleType()),
        T.StructField("fraud_score", T.DoubleType()),
        T.StructField("decision", T.StringType()),
        T.StructField("is_fraud_actual", T.IntegerType()),
        T.StructField("scored_at", T.TimestampType()),
    ]
)
