"""Explicit schemas of the inputs as DDL text; nothing is inferred."""

# Canonical bar columns.
BAR_COLUMNS = [
    "open", "high", "low", "close",
    "open_ask_price", "close_ask_price", "open_bid_price", "close_bid_price",
    "vwap", "buy_volume", "sell_volume", "total_volume",
    "buy_trades_count", "sell_trades_count", "total_trades_count",
]

# Partition columns are declared too: a frequency such as 1d would be inferred as a number.
BAR_TABLE = (
    "ts timestamp, " + ", ".join(f"{c} double" for c in BAR_COLUMNS)
    + ", symbol string, freq string, year int, month int")
FEATURE_TABLE = (
    "ticker string, timestamp timestamp, alpha double, feature_hash string, freq string")

QUOTE_FILE = "timestamp bigint, bid_price double, ask_price double"

ALPHA_CATALOG = "frequency string, alpha string"
IDEA = "idea string"

_REF = "struct<value:string,name:string>"
_META = "struct<CreateTime:string,LastUpdatedTime:string>"
EXTERNAL_ACCOUNT = (
    f"Id string, Name string, AccountType string, CurrentBalance string, CurrencyRef {_REF}, MetaData {_META}"
)
EXTERNAL_TRANSACTION = (
    f"Id string, TransactionType string, Amount string, Description string, AccountRef {_REF}, "
    f"TxnDate string, status string, MetaData {_META}"
)
EXTERNAL_BUDGET = (
    "Id string, Name string, StartDate string, EndDate string, "
    f"BudgetDetail array<struct<AccountRef:{_REF},Amount:string,ActualAmount:string>>, MetaData {_META}"
)
_CELLS = "struct<ColData:array<struct<value:string>>>"
EXTERNAL_REPORT = (
    "Header struct<Time:string,ReportName:string,StartPeriod:string,EndPeriod:string,Currency:string>, "
    f"Rows array<struct<Header:map<string,string>,Rows:array<{_CELLS}>,Summary:{_CELLS}>>"
)

COMMAND_JSON = "intent string, confidence double, entities map<string,string>"
TOOL_CALLS = "array<struct<toolName:string,result:string,error:string>>"

CALL_EVENT = "type string, callId string, call_id string, data string, timestamp timestamp"
CALL_EVENT_DATA = (
    "call_type string, phone_number string, status string, segment_id string, speaker string, text string, "
    "rating int, comments string, segment struct<id:string,speaker:string,text:string>"
)
