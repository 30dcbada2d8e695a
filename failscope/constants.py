"""Fixed values the results depend on."""

# Suite names, searched in this order.
SUITES = [
    "ptp-oc", "ptp-tc", "dtmf", "tcp-xp-tec", "ipv6-host", "v6bgp4", "rtp", "sctp",
    "lacp-tec", "ipv4", "ptp-bc", "udp-tec", "sip", "udp", "tcp", "lacp",
]

# File-name token -> protocol, searched in this order.
PROTOCOLS = [
    ("dtmf", "DTMF"), ("ptp", "PTP"), ("ipv6", "IPv6"), ("ipv4", "IPv4"), ("sip", "SIP"),
    ("lacp", "LACP"), ("tcp", "TCP"), ("udp", "UDP"), ("sct", "SCTP"),
]

# Status words.
STATUS_WORDS = ["PASSED", "FAILED", "ABORTED", "PASS", "FAIL", "ABORT"]
STATUSES = ["PASS", "FAIL", "ABORT"]

# Cluster -> root cause.
ROOT_CAUSES = {
    0: "Interface / Port Mismatch",
    1: "Capture / ID Handling Error",
    2: "CLI / Command Execution Failure",
    3: "Test Result / Validation Issue",
    4: "PTP Transmission / PDELAY_RESP Failure",
    5: "Bit / Marker Configuration Error",
    6: "DUT Configuration Value Error",
    7: "DUT Port / State Mismatch",
    8: "Announce / SIP Transmission Error",
    9: "PTP Command / Domain Configuration Error",
}

# Stop words of the two keyword extractors.
KEYWORD_STOP_WORDS = ["the", "and", "for", "to", "in", "of", "on", "with", "is", "a", "at", "no", "error"]
NOTEBOOK_STOP_WORDS = ["the", "and", "for", "to", "in", "of", "on", "with", "is", "a", "at", "from", "by"]

# Sentinels that stand for a missing value.
NO_ERROR = "No Error"
REASON_NOT_FOUND = "Failure reason not found"
NO_KEYWORDS = "No keywords"
EMPTY_KEYWORDS = "<no_keywords>"
UNKNOWN = "Unknown"
NORMAL = "Normal"
UNCATEGORIZED = "Uncategorized"

# Patterns of the line and header parsers.
# (?U) gives \s, \w, \d, \b their Unicode meaning.
SIMPLE_LINE = r"(?U)^(\S+)\s+-\s+(\S+)\s+-\s+(\S+)"
LINE_TIMESTAMP = r"(?U)\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
LINE_TEST_CASE = r"(?iU)(tc[_\-]?\S+)"
LINE_DUT_VERSION = r"(?iU)DUT[_\s]?(v?\d+(\.\d+)*)"
LINE_CONFIG = r"(?iU)config[:=]\s*([a-zA-Z0-9_\-\.]+)"
CLOCK = r"(?U)^(\d{2}:\d{2}:\d{2}\.\d+)"
RESULT_PATTERNS = [
    (r"#\s*Result\s*[:\-]?\s*(PASSED|FAILED|ABORTED|PASS|FAIL|ABORT)\b\s*[:\-]?\s*(.*)", 2),
    (r"#\s*TEST\s*CASE\s*(PASSED|FAILED|ABORTED|PASS|FAIL|ABORT)\b\s*[:\-]?\s*(.*)", 2),
    (r"\b(TEST\s*CASE\s*)?(PASSED|FAILED|ABORTED|PASS|FAIL|ABORT)\b\s*[:\-]?\s*(.*)", 3),
]
HEADER_PATTERNS = {
    "dut_name": r"(?iU)DUT\s*NAME\s*[:=]\s*(.+)",
    "dut_version": r"(?iU)DUT\s*VERSION\s*[:=]\s*(.+)",
    "os_version": r"(?iU)OS\s*VERSION\s*[:=]\s*(.+)",
    "config": r"(?iU)CONFIGURATION\s*[:=]\s*(.+)",
    "test_case": r"(?iU)Test\s*Case\s*[:=]\s*([A-Za-z0-9_\-\.]+)",
}
# Every header pattern needs one of these words before its separator.
HEADER_HINT = r"(?iU)(name|version|configuration|case)\s*[:=]"
NAME_VERSION_TAG = r"(?iU)_(AS|TEC|IP|BC|OC|V\d+)[-_]?\d{8}"
LINE_VERSION = r"(?iU)version\s*[:=]\s*([A-Za-z0-9\.\-_]+)"
NAME_DUT = r"(?iU)(DUT[^\W_]+)"
NAME_TEST_CASE = r"(tc_[a-zA-Z0-9_\-\.]+)"
NAME_DATE = r"(?U)(\d{8})"
CONTEXT_KEYWORDS = r"(?iU)(error|fail|reason|exception|invalid|timeout|abort|crash|assert|not\s+transmit)"
SNIPPET_KEYWORDS = r"(?i)fail|error|exception|abort"

# Header fallbacks.
DEFAULT_DUT = "DUT_Auto"
DEFAULT_OS = "Linux"
DEFAULT_CONFIG = "Standard_Config"
DEFAULT_TEST_CASE = "default_tc"
DEFAULT_DUT_VERSION = "Generic_v1.0"

# Column candidates and report fields.
CRITICAL_FIELDS = ["test_case_id", "dut", "suite", "config", "error_msg", "status", "run_date", "timestamp"]
NUMERIC_CANDIDATES = [
    "past_failure_rate", "failure_rate", "suite_fail_rate", "dut_fail_rate", "time_since_last_failure",
    "execution_duration", "executiontime", "execution_frequency", "avg_duration", "keyword_fail",
    "rolling_anomaly_rate", "anomaly_score", "mean_anomaly_score", "exec_day", "exec_hour",
]
CATEGORY_CANDIDATES = [
    "test_case", "test_case_id", "dut", "suite", "cluster_label", "clusterlabel",
    "regression_group", "schedule_cycle",
]
CLUSTER_CANDIDATES = ["cluster_label", "clusterlabel", "cluster"]
ANOMALY_NUMERIC = ["execution_duration", "failure_freq_suite", "failure_freq_dut", "time_since_last_failure"]
TRAINING_META = [
    "filename", "dut", "dut_version", "os_version", "config", "test_case_id", "suite", "run_date",
    "execution_duration", "failure_freq_suite", "failure_freq_dut", "recent_failure_flag",
]
TRAINING_FEATURES = ["error_msg", "cluster", "root_cause_label", "keywords"]

# The English stop words of Spark ML.
SPARK_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on",
    "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll", "you'll", "he'll",
    "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's",
    "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't",
    "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't",
    "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's",
    "where's", "who's", "why's", "would",
]
