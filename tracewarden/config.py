"""Settings of a scan or a training run (plain dataclasses, convertible to one-row tables)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Default policy of the rule engine.
ALLOWED_METHODS = ("GET", "HEAD", "POST", "OPTIONS")
ALLOWED_VERSIONS = ("HTTP/1.0", "HTTP/1.1", "HTTP/2", "HTTP/2.0", "HTTP/3", "HTTP/3.0")
ALLOWED_CONTENT_TYPES = (
    "application/x-www-form-urlencoded",
    "multipart/form-data",
    "text/xml",
    "application/xml",
    "application/soap+xml",
    "application/json",
)
ALLOWED_CHARSETS = ("utf-8", "iso-8859-1", "iso-8859-15", "windows-1252")
RESTRICTED_HEADERS = (
    "content-encoding",
    "proxy",
    "lock-token",
    "content-range",
    "if",
    "x-http-method-override",
    "x-http-method",
    "x-method-override",
    "x-middleware-subrequest",
)
RESTRICTED_HEADERS_EXTENDED = ("accept-charset",)
RESTRICTED_EXTENSIONS = (
    "ani", "asa", "asax", "ascx", "backup", "bak", "bat", "cdx", "cer", "cfg",
    "cmd", "com", "compositefont", "config", "conf", "crt", "cs", "csproj", "csr", "dat",
    "db", "dbf", "dist", "dll", "dos", "dpkg-dist", "drv", "gadget", "hta", "htr",
    "htw", "ida", "idc", "idq", "inc", "inf", "ini", "jse", "key", "licx",
    "lnk", "log", "mdb", "msc", "ocx", "old", "pass", "pdb", "pfx", "pif",
    "pem", "pol", "prf", "printer", "pwd", "rdb", "rdp", "reg", "resources", "resx",
    "scr", "sct", "shs", "sql", "swp", "sys", "tlb", "tmp", "url", "vb",
    "vbe", "vbs", "vbproj", "vsdisco", "vxd", "webinfo", "ws", "wsc", "wsf", "wsh",
    "xsd", "xsx",
)

# Points a match adds, by severity.
SEVERITY_POINTS = {"CRITICAL": 5, "ERROR": 4, "WARNING": 3, "NOTICE": 2}

# The category counters kept next to the level totals.
CATEGORIES = (
    "sql_injection",
    "xss",
    "rfi",
    "lfi",
    "rce",
    "php_injection",
    "http_violation",
    "session_fixation",
)


@dataclass(frozen=True)
class ScanConfig:
    """Levels, thresholds and policy lists of one scan. ``None`` limits are not enforced."""

    blocking_pl: int = 1
    detection_pl: int | None = None
    inbound_threshold: int = 5
    outbound_threshold: int = 4
    reporting_level: int = 4
    early_blocking: bool = False
    sampling_pct: int = 100
    skip_response: bool = False
    validate_utf8: bool = False
    points: dict[str, int] = field(default_factory=lambda: dict(SEVERITY_POINTS))
    allowed_methods: tuple[str, ...] = ALLOWED_METHODS
    allowed_versions: tuple[str, ...] = ALLOWED_VERSIONS
    allowed_content_types: tuple[str, ...] = ALLOWED_CONTENT_TYPES
    allowed_charsets: tuple[str, ...] = ALLOWED_CHARSETS
    restricted_headers: tuple[str, ...] = RESTRICTED_HEADERS
    restricted_headers_extended: tuple[str, ...] = RESTRICTED_HEADERS_EXTENDED
    restricted_extensions: tuple[str, ...] = RESTRICTED_EXTENSIONS
    max_num_args: int | None = None
    arg_name_length: int | None = None
    arg_length: int | None = None
    total_arg_length: int | None = None
    max_file_size: int | None = None
    combined_file_sizes: int | None = None

    @property
    def detection_level(self) -> int:
        return self.blocking_pl if self.detection_pl is None else self.detection_pl

    def check(self) -> "ScanConfig":
        """Reject a detection level below the blocking level and out-of-range settings."""
        if self.detection_level < self.blocking_pl:
            raise ValueError(
                f"detection level {self.detection_level} is lower than blocking level {self.blocking_pl}"
            )
        if not 0 <= self.sampling_pct <= 100:
            raise ValueError(f"sampling_pct out of range: {self.sampling_pct}")
        return self

    def to_frame(self, spark: SparkSession) -> DataFrame:
        row = asdict(self)
        row["detection_pl"] = self.detection_level
        schema = (
            "blocking_pl int, detection_pl int, inbound_threshold int, outbound_threshold int, reporting_level int,"
            "early_blocking boolean, sampling_pct int, skip_response boolean, validate_utf8 boolean,"
            "points map<string,int>, allowed_methods array<string>, allowed_versions array<string>,"
            "allowed_content_types array<string>, allowed_charsets array<string>, restricted_headers array<string>,"
            "restricted_headers_extended array<string>, restricted_extensions array<string>, max_num_args int,"
            "arg_name_length int, arg_length int, total_arg_length int, max_file_size int, combined_file_sizes int"
        )
        values = [list(v) if isinstance(v, tuple) else v for v in row.values()]
        return spark.createDataFrame([tuple(values)], schema)


@dataclass(frozen=True)
class FeatureConfig:
    """Which columns feed a model and how their text is encoded."""

    text: tuple[str, ...] = ("RequestURIPath", "RequestURIQuery", "RequestBody", "UserAgent")
    categorical: tuple[str, ...] = ("RequestMethod",)
    numeric: tuple[str, ...] = ("RequestLength", "PathLength", "QueryLength")
    label: str = "AIVerdictLabel"
    label_values: tuple[str, ...] = ("benign", "malicious")
    mode: str = "sparse"
    analyzer: dict[str, str] = field(default_factory=dict)
    max_terms: dict[str, int] = field(default_factory=dict)
    ngrams: dict[str, tuple[int, int]] = field(default_factory=lambda: {"UserAgent": (1, 2)})
    max_len: dict[str, int] = field(default_factory=lambda: {"UserAgent": 100})
    scale_numeric: bool = True
    test_size: float = 0.2
    seed: int = 42

    def terms_for(self, col: str) -> int:
        return self.max_terms.get(col, 5000)

    def ngrams_for(self, col: str) -> tuple[int, int]:
        return self.ngrams.get(col, (1, 6))

    def len_for(self, col: str) -> int:
        return self.max_len.get(col, 50)

    def analyzer_for(self, col: str) -> str:
        return self.analyzer.get(col, "char")
