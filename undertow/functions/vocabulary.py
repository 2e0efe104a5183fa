"""Words, patterns and thresholds that decide how names and cells are read.

They are parameters of the operators; nothing here is computed.
"""

# Cells that mean "missing" after trimming.
NULL_TOKENS = ("", "-", "NA", "N/A", "n/a", "null", "NULL")

# Characters left out when text is read as a number, besides white space.
MONEY_SIGNS = "$€₹,\\()"

# Words (lower case) that a header search does not take for a number.
HEADER_NON_NUMBERS = ("", "-", "na", "n/a", "null", "none")

# Characters Python's str.strip() would remove.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Text that looks like a date, matched anywhere in the cell, ignoring case.
DATE_LIKE = (
    r"(?i)\d{1,4}[-/]\d{1,2}(?:[-/]\d{1,4})?"
    r"|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
)

# Date layouts tried in this order; month comes before day where both could fit.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m:s.SSSSSS",
    "yyyy-M-d'T'H:m:s.SSSSSS",
    "yyyy-M-d'T'H:m:sXXX",
    "yyyy-M-d'T'H:m:s.SSSSSSXXX",
    "yyyy/M/d",
    "yyyy/M/d H:m:s",
    "M/d/yyyy",
    "M/d/yyyy H:m",
    "M/d/yyyy H:m:s",
    "M/d/yyyy h:m a",
    "M/d/yyyy h:m:s a",
    "M/d/yy",
    "M-d-yyyy",
    "d/M/yyyy",
    "d-M-yyyy",
    "MMM d, yyyy",
    "MMM d yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
    "MMM yyyy",
    "MMMM yyyy",
)

# Column roles: the first role with a word contained in the lower-case name wins.
ROLE_WORDS = (
    ("outcome", ("final", "result", "score_final", "exam_final")),
    ("driver", ("internal", "assign", "attend", "lab", "study", "traffic", "spend", "discount")),
    ("segment", ("section", "region", "product", "faculty", "category", "segment", "group")),
    ("meta", ("id", "name", "date", "month")),
)
DEFAULT_ROLE = "metric"

# Numeric columns whose high values are the bad ones.
HIGHER_IS_WORSE = (
    "return", "deliver", "delay", "downtime", "defect", "error",
    "complaint", "churn", "cost", "dropout", "fail", "absence", "late",
)

# Numeric columns with no clear good direction: left out of segment gaps.
SEGMENT_SKIP = ("discount", "spend", "price", "hour", "age", "count", "txn", "id")

# Name tokens of columns that should lie in 0..100.
PERCENT_TOKENS = (
    "attend", "attendance", "percent", "pct", "assign", "assignment",
    "assignments", "mark", "marks", "score", "scores", "rating", "ratings",
)
PERCENT_SKIP = ("hour", "spend", "sales", "traffic", "time", "txn", "id")

# Names that hint at a key column.
KEY_WORDS = ("id", "code", "sku", "key", "no.", "number", "ref")

# Names that hint at a time axis.
TIME_WORDS = ("date", "month", "week")

MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# File formats the readers accept.
KNOWN_EXTENSIONS = ("csv", "tsv", "txt", "xlsx", "xls", "json", "parquet")

# Column names that betray a binary file read as text.
BINARY_MARKERS = ("PK\x03\x04", "[Content_Types]", "\x00", "xl/_rels", ".xml ")


def has_word(name: str, words: tuple[str, ...]) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in words)
