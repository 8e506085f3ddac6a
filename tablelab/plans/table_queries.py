"""Queries over scans, profiles, cleaning, exploration, text functions and the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelab.functions import columns as C
from tablelab.operators import cleaning, eda, findings, profile, runlog
from tablelab.plans.inputs import DIRTY, TIDY, dirty_orders, table
from tablelab.plans.registry import query

DIRTY_NAMES = ["Order Key", " Total Value ", "Status-Code", "cust/text", "const", "empty"]
DIRTY_TYPES = ["bigint", "double", "string", "string", "double", "double"]
TIDY_NAMES = ["order_key", "total_value", "status_code", "cust_text", "const", "empty"]


def _q(name: str) -> str:
    return '"' + name + '"'


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# --- scans and profile -----------------------------------------------------------------


@query(
    "preview",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 8",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").drop("o_orderdate")
    return profile.preview(rows, ["o_orderkey"])


def _profile_sql(source: str, names: list[str], types: list[str]) -> str:
    return _union(
        [
            f"""SELECT CAST({i} AS INTEGER) AS position, '{n}' AS name, '{t}' AS dtype, count(*) - count({_q(n)}) AS missing,
            count(DISTINCT {_q(n)}) AS "unique", {'FALSE' if t in ('string', 'timestamp_ntz') else 'TRUE'} AS "numeric" FROM {source}"""
            for i, (n, t) in enumerate(zip(names, types))
        ]
    )


@query("profile_columns", f"WITH {DIRTY} " + _profile_sql("dirty", DIRTY_NAMES, DIRTY_TYPES))
def _(spark, folder):
    return profile.profile_columns(dirty_orders(spark, folder))


LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


@query("profile_lineitem", _profile_sql("lineitem", list(LINEITEM), list(LINEITEM.values())))
def _(spark, folder):
    return profile.profile_columns(table(spark, folder, "lineitem"))


@query("profile_table", f"WITH {DIRTY} SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count FROM dirty")
def _(spark, folder):
    return profile.profile_table(dirty_orders(spark, folder))


DUPLICATES = (
    'SELECT CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS c FROM dirty GROUP BY '
    + ", ".join(_q(n) for n in DIRTY_NAMES)
    + ")"
)


@query("duplicate_count", f"WITH {DIRTY} {DUPLICATES}")
def _(spark, folder):
    return profile.duplicate_count(dirty_orders(spark, folder))


@query(
    "missing_report",
    f"WITH {DIRTY} SELECT * FROM ("
    + _union(
        [
            f"""SELECT '{n}' AS "column", count(*) - count({_q(n)}) AS missing, '{'mode' if t == 'string' else 'median'}' AS strategy FROM dirty"""
            for n, t in zip(DIRTY_NAMES, DIRTY_TYPES)
        ]
    )
    + ") WHERE missing > 0",
)
def _(spark, folder):
    return profile.missing_report(dirty_orders(spark, folder))


PARSED = "TRY_CAST(replace(trim({}), ',', '') AS DOUBLE)"


@query(
    "numeric_ratio",
    f"WITH {DIRTY} SELECT *, ratio >= 0.85 AS suggested FROM ("
    + _union(
        [
            f"""SELECT '{n}' AS "column", round(count({PARSED.format(_q(n))}) / CAST(count({_q(n)}) AS DOUBLE), 6) AS ratio FROM dirty"""
            for n in ("Status-Code", "cust/text")
        ]
    )
    + ")",
)
def _(spark, folder):
    return profile.numeric_ratio(dirty_orders(spark, folder)).withColumn("ratio", F.round("ratio", 6))


def _fence_sql(source: str, names: list[str]) -> str:
    parts = _union(
        [
            f"SELECT '{n}' AS c, {_q(n)} AS v, quantile_cont({_q(n)}, 0.25) OVER () AS q1, quantile_cont({_q(n)}, 0.75) OVER () AS q3, count({_q(n)}) OVER () AS n FROM {source}"
            for n in names
        ]
    )
    return f"""SELECT c AS "column", round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper,
      count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
      FROM ({parts}) WHERE n >= 8 AND q3 > q1 GROUP BY c, q1, q3"""


@query("iqr_outliers", _fence_sql("(SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, value FROM events)", ["event_id", "user_id", "value"]))
def _(spark, folder):
    found = profile.iqr_outliers(table(spark, folder, "events"))
    return found.select("column", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "outliers")


@query("iqr_documents", _fence_sql("(SELECT CAST(doc_id AS DOUBLE) AS doc_id, CAST(n_chars AS DOUBLE) AS n_chars FROM documents)", ["doc_id", "n_chars"]))
def _(spark, folder):
    found = profile.iqr_outliers(table(spark, folder, "documents"))
    return found.select("column", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "outliers")


PROPOSAL_SQL = f"""found AS (
  SELECT 0 AS pos, 0 AS step, 'normalize_columns' AS operation, CAST(NULL AS VARCHAR) AS col, CAST(6 AS BIGINT) AS affected
  UNION ALL SELECT 1, 0, 'drop_duplicates', NULL, duplicates FROM ({DUPLICATES})
  UNION ALL {_union([f"SELECT {i + 2}, 1, 'fill_missing', '{n}', count(*) - count({_q(n)}) FROM dirty" for i, n in enumerate(DIRTY_NAMES)])}
  UNION ALL {_union([f"SELECT {i + 2}, 2, 'convert_numeric', '{n}', count({_q(n)}) FROM dirty HAVING count({PARSED.format(_q(n))}) >= 0.85 * count({_q(n)})" for i, n in ((2, "Status-Code"), (3, "cust/text"))])}
  UNION ALL SELECT CASE "column" WHEN 'Order Key' THEN 2 ELSE 3 END, 3, 'cap_outliers', "column", outliers
    FROM ({_fence_sql('(SELECT CAST("Order Key" AS DOUBLE) AS "Order Key", " Total Value " FROM dirty)', ["Order Key", " Total Value "])})
), proposal AS (
  SELECT CAST(row_number() OVER (ORDER BY pos, step) AS INTEGER) AS ord, operation || coalesce('::' || col, '') AS id, operation,
    col AS "column", CASE operation WHEN 'normalize_columns' THEN '列名规范化' WHEN 'drop_duplicates' THEN '重复记录'
      WHEN 'fill_missing' THEN '缺失值' WHEN 'convert_numeric' THEN '类型转换' ELSE '异常值' END AS category,
    affected, operation <> 'cap_outliers' AS recommended
  FROM found WHERE affected > 0)"""


@query("cleaning_proposal", f"WITH {DIRTY}, {PROPOSAL_SQL} SELECT * FROM proposal")
def _(spark, folder):
    return profile.cleaning_proposal(dirty_orders(spark, folder)).drop("detail")


@query(
    "finding_lines",
    f"""WITH {DIRTY}, {PROPOSAL_SQL} SELECT CAST(ord AS BIGINT) AS ord, category AS item, id AS detail FROM proposal WHERE ord <= 4
    UNION ALL SELECT 5, 'more', CAST(count(*) AS VARCHAR) FROM proposal WHERE ord > 4 HAVING count(*) > 0""",
)
def _(spark, folder):
    return findings.finding_lines(profile.cleaning_proposal(dirty_orders(spark, folder)), "category", "id", 4)


# --- cleaning --------------------------------------------------------------------------

TIDY_COLUMNS = ", ".join(TIDY_NAMES)


@query(
    "clean_normalize",
    f"""WITH {DIRTY} SELECT "Order Key" AS order_key, " Total Value " AS total_value, "Status-Code" AS status_code,
    "cust/text" AS custtext, const, empty FROM dirty""".replace("custtext", "cust_text"),
)
def _(spark, folder):
    return cleaning.normalize_columns(dirty_orders(spark, folder))


@query("clean_dedup", f"WITH {DIRTY} SELECT DISTINCT * FROM dirty")
def _(spark, folder):
    return cleaning.drop_duplicates(dirty_orders(spark, folder))


@query("clean_to_numeric", f"WITH {TIDY} SELECT {TIDY_COLUMNS} FROM tidy")
def _(spark, folder):
    return cleaning.to_numeric(cleaning.normalize_columns(dirty_orders(spark, folder)), ["cust_text"])


@query(
    "clean_fill_median",
    f"""WITH {TIDY} SELECT order_key, coalesce(total_value, (SELECT median(total_value) FROM tidy)) AS total_value,
    coalesce(cust_text, (SELECT median(cust_text) FROM tidy)) AS cust_text FROM tidy""",
)
def _(spark, folder):
    rows = cleaning.to_numeric(cleaning.normalize_columns(dirty_orders(spark, folder)), ["cust_text"])
    return cleaning.fill_median(rows, ["total_value", "cust_text"]).select("order_key", "total_value", "cust_text")


MODE = "(SELECT status_code FROM tidy WHERE status_code IS NOT NULL GROUP BY status_code ORDER BY count(*) DESC, status_code LIMIT 1)"


@query("clean_fill_mode", f"WITH {TIDY} SELECT order_key, coalesce(status_code, {MODE}) AS status_code FROM tidy")
def _(spark, folder):
    rows = cleaning.normalize_columns(dirty_orders(spark, folder)).select("order_key", "status_code")
    return cleaning.fill_mode(rows)


CAPPED = """bounds AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
 SELECT event_id, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), value)) AS value FROM events, bounds"""


@query("clean_cap_iqr", f"SELECT event_id, round(value, 6) AS value FROM (WITH {CAPPED})")
def _(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "value")
    return cleaning.cap_iqr(rows, ["value"]).withColumn("value", F.round("value", 6))


@query(
    "clean_inf_to_null",
    "SELECT o_orderkey, CASE WHEN o_orderpriority <> '2-HIGH' THEN o_totalprice END AS total FROM orders",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    high = F.col("o_orderpriority") == "2-HIGH"
    signed = F.when(F.col("o_orderstatus") == "O", float("-inf")).otherwise(float("inf"))
    return cleaning.inf_to_null(orders.select("o_orderkey", F.when(high, signed).otherwise(F.col("o_totalprice")).alias("total")))


ACCEPTED = [
    "normalize_columns", "drop_duplicates", "convert_numeric::cust/text", "fill_missing:: Total Value ",
    "fill_missing::Status-Code", "fill_missing::cust/text", "cap_outliers:: Total Value ",
]
CLEAN = f"""{TIDY}, one AS (SELECT DISTINCT * FROM tidy), fills AS (SELECT median(total_value) AS mt, median(cust_text) AS mc,
  {MODE.replace('tidy', 'one')} AS ms FROM one),
 filled AS (SELECT order_key, coalesce(total_value, mt) AS total_value, coalesce(status_code, ms) AS status_code,
   coalesce(cust_text, mc) AS cust_text, const, empty FROM one, fills),
 fences AS (SELECT quantile_cont(total_value, 0.25) AS q1, quantile_cont(total_value, 0.75) AS q3 FROM filled),
 clean AS (SELECT order_key, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), total_value)) AS total_value, status_code,
   cust_text, const, empty FROM filled, fences)"""


@query("apply_cleaning", f"WITH {CLEAN} SELECT order_key, round(total_value, 6) AS total_value, status_code, cust_text, const, empty FROM clean")
def _(spark, folder):
    out = cleaning.apply_cleaning(dirty_orders(spark, folder), ACCEPTED).data
    return out.withColumn("total_value", F.round("total_value", 6))


@query(
    "cleaning_log",
    f"""WITH {CLEAN} SELECT 1 AS ord, 'normalize_columns' AS operation, CAST(NULL AS VARCHAR) AS "column", '4 renamed' AS detail, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high
    UNION ALL SELECT 2, 'drop_duplicates', NULL, CAST((SELECT count(*) FROM dirty) - (SELECT count(*) FROM one) AS VARCHAR) || ' removed', NULL, NULL
    UNION ALL SELECT 3, 'convert_numeric', 'cust_text', 'to double', NULL, NULL
    UNION ALL SELECT 4, 'fill_missing', 'total_value', 'median', round(mt, 4), round(mt, 4) FROM fills
    UNION ALL SELECT 5, 'fill_missing', 'status_code', ms, NULL, NULL FROM fills
    UNION ALL SELECT 6, 'fill_missing', 'cust_text', 'median', round(mc, 4), round(mc, 4) FROM fills
    UNION ALL SELECT 7, 'cap_outliers', 'total_value', 'IQR', round(q1 - 1.5 * (q3 - q1), 4), round(q3 + 1.5 * (q3 - q1), 4) FROM fences""",
)
def _(spark, folder):
    log = cleaning.apply_cleaning(dirty_orders(spark, folder), ACCEPTED).log()
    return log.select("ord", "operation", "column", "detail", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(
    "renamed_columns",
    "SELECT * FROM (VALUES (1, 'Order Key', 'order_key'), (2, ' Total Value ', 'total_value'), (3, 'Status-Code', 'status_code'), "
    "(4, 'cust/text', 'cust_text')) AS t(ord, before, after)",
)
def _(spark, folder):
    return cleaning.apply_cleaning(dirty_orders(spark, folder), ["normalize_columns"]).renamed()


def _sizes(side: str, source: str, names: list[str]) -> str:
    gaps = " + ".join(f"count(*) - count({_q(n)})" for n in names)
    return f"""SELECT '{side}' AS side, count(*) AS "rows", CAST(6 AS BIGINT) AS "columns", CAST({gaps} AS BIGINT) AS missing,
      TRUE AS rows_removed, TRUE AS cells_filled, TRUE AS values_capped FROM {source}"""


@query("cleaning_summary", f"WITH {CLEAN} " + _union([_sizes("original", "dirty", DIRTY_NAMES), _sizes("cleaned", "clean", TIDY_NAMES)]))
def _(spark, folder):
    return cleaning.apply_cleaning(dirty_orders(spark, folder), ACCEPTED).summary()


# --- exploration -----------------------------------------------------------------------


def _describe_sql(source: str, names: list[str]) -> str:
    return _union(
        [
            f"""SELECT '{n}' AS "column", count({_q(n)}) AS count, round(avg({_q(n)}), 8) AS mean, round(stddev_samp({_q(n)}), 8) AS std,
            round(CAST(min({_q(n)}) AS DOUBLE), 6) AS min, round(CAST(median({_q(n)}) AS DOUBLE), 6) AS median, round(CAST(max({_q(n)}) AS DOUBLE), 6) AS max FROM {source}"""
            for n in names
        ]
    )


@query("describe_numeric", _describe_sql("lineitem", [n for n, t in LINEITEM.items() if t in ("bigint", "int", "double")]))
def _(spark, folder):
    return eda.describe_numeric(table(spark, folder, "lineitem"), digits=8)


@query("describe_dirty", f"WITH {DIRTY} " + _describe_sql("dirty", ["Order Key", " Total Value ", "const", "empty"]))
def _(spark, folder):
    return eda.describe_numeric(dirty_orders(spark, folder), digits=8)


def _histogram_sql(source: str, names: list[str]) -> str:
    return _union(
        [
            f"""SELECT '{n}' AS "column", bin, round(low + (bin - 1) * ((high - low) / 24), 6) AS bin_low,
            round(low + bin * ((high - low) / 24), 6) AS bin_high, count(v) AS n
            FROM (SELECT CASE WHEN max({_q(n)}) > min({_q(n)}) THEN min({_q(n)}) ELSE min({_q(n)}) - 0.5 END AS low,
                         CASE WHEN max({_q(n)}) > min({_q(n)}) THEN max({_q(n)}) ELSE max({_q(n)}) + 0.5 END AS high FROM {source})
            CROSS JOIN (SELECT CAST(range AS INTEGER) + 1 AS bin FROM range(24))
            LEFT JOIN (SELECT CAST({_q(n)} AS DOUBLE) AS v FROM {source}) ON least(24, 1 + floor((v - low) / (high - low) * 24)) = bin
            GROUP BY bin, low, high"""
            for n in names
        ]
    )


@query("histogram", _histogram_sql("events", ["value", "user_id"]))
def _(spark, folder):
    return _rounded_bins(eda.histogram(table(spark, folder, "events"), ["value", "user_id"]))


@query("histogram_dirty", f"WITH {DIRTY} " + _histogram_sql("dirty", [" Total Value ", "const"]))
def _(spark, folder):
    return _rounded_bins(eda.histogram(dirty_orders(spark, folder), [" Total Value ", "const", "empty"]))


def _rounded_bins(df):
    return df.withColumns({"bin_low": F.round("bin_low", 6), "bin_high": F.round("bin_high", 6)})


@query(
    "kde_curve",
    """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS bw FROM events)
    SELECT CAST(g AS INTEGER) AS grid_no, round(lo + g * ((hi - lo) / 199), 6) AS x,
      round(sum(exp(-0.5 * pow((value - (lo + g * ((hi - lo) / 199))) / bw, 2))) / (n * bw * sqrt(2 * pi())), 9) AS density
    FROM events, s, (SELECT range AS g FROM range(200)) GROUP BY g, lo, hi, n, bw""",
)
def _(spark, folder):
    curve = eda.kde_curve(table(spark, folder, "events"), "value")
    return curve.select("grid_no", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


def _correlation_sql(source: str, names: list[str]) -> str:
    return _union(
        [
            f"""SELECT CAST({i} AS INTEGER) AS pos_a, CAST({j} AS INTEGER) AS pos_b, '{a}' AS col_a, '{b}' AS col_b,
            CASE WHEN r IS NULL OR isnan(r) OR abs(r) < 5e-7 THEN 0.0 ELSE round(r, 6) END AS r
            FROM (SELECT {'CASE WHEN max(' + _q(a) + ') > min(' + _q(a) + ') THEN CAST(1.0 AS DOUBLE) END' if i == j else f'CASE WHEN var_pop({_q(a)}) > 0 AND var_pop({_q(b)}) > 0 THEN corr({_q(a)}, {_q(b)}) END'} AS r FROM {source})"""
            for i, a in enumerate(names)
            for j, b in enumerate(names)
        ]
    )


@query("correlation_matrix", _correlation_sql("lineitem", [n for n, t in LINEITEM.items() if t in ("bigint", "int", "double")]))
def _(spark, folder):
    return eda.correlation_matrix(table(spark, folder, "lineitem"))


@query("correlation_dirty", f"WITH {TIDY} " + _correlation_sql("tidy", ["order_key", "total_value", "cust_text", "const", "empty"]))
def _(spark, folder):
    rows = cleaning.to_numeric(cleaning.normalize_columns(dirty_orders(spark, folder)), ["cust_text"])
    return eda.correlation_matrix(rows)


PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]


@query(
    "top_correlations",
    f"SELECT col_a, col_b, r FROM ({_correlation_sql('part', PART_NUMBERS)}) WHERE pos_a < pos_b ORDER BY abs(r) DESC, col_a DESC, col_b DESC LIMIT 2",
)
def _(spark, folder):
    return findings.top_correlations(eda.correlation_matrix(table(spark, folder, "part")), 2)


@query(
    "scatter_points",
    _union([f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, p_retailprice AS y FROM part" for c in ("p_partkey", "p_size")]),
)
def _(spark, folder):
    return eda.scatter_points(table(spark, folder, "part"), "p_retailprice")


@query(
    "scatter_sample",
    "SELECT feature, p_partkey, x, y FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS place FROM ("
    + _union([f"SELECT '{c}' AS feature, p_partkey, CAST({c} AS DOUBLE) AS x, p_retailprice AS y FROM part" for c in ("p_size",)])
    + ") WHERE x IS NOT NULL AND y IS NOT NULL) WHERE place <= 300",
)
def _(spark, folder):
    return eda.scatter_sample(table(spark, folder, "part"), "p_retailprice", ["p_partkey"], points=300)


@query(
    "scatter_bins",
    "SELECT feature, CAST(xb AS INTEGER) AS x_bin, CAST(yb AS INTEGER) AS y_bin, count(*) AS n FROM ("
    + _union(
        [
            f"""SELECT '{c}' AS feature,
            least(24, 1 + floor((CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 24)) AS xb,
            least(24, 1 + floor((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) * 24)) AS yb
            FROM lineitem"""
            for c in ("l_quantity", "l_discount", "l_tax")
        ]
    )
    + ") GROUP BY ALL",
)
def _(spark, folder):
    return eda.scatter_bins(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


def _top_sql(source: str, names: list[str], rows: int) -> str:
    return (
        "SELECT * FROM ("
        + _union(
            [
                f"""SELECT '{n}' AS "column", coalesce({_q(n)}, '空值') AS value, count(*) AS n,
                CAST(row_number() OVER (ORDER BY count(*) DESC, coalesce({_q(n)}, '空值')) AS INTEGER) AS rank FROM {source} GROUP BY 2"""
                for n in names
            ]
        )
        + f") WHERE rank <= {rows}"
    )


@query("top_categories", f"WITH {DIRTY} " + _top_sql("dirty", ["Status-Code", "cust/text"], 12))
def _(spark, folder):
    return eda.top_categories(dirty_orders(spark, folder))


@query("top_categories_conversations", _top_sql("conversations", ["role", "text"], 12))
def _(spark, folder):
    return eda.top_categories(table(spark, folder, "conversations"))


def _describe_categories_sql(source: str, names: list[str]) -> str:
    return _union(
        [
            f"""SELECT '{n}' AS "column", (SELECT count(DISTINCT {_q(n)}) FROM {source}) AS "unique", value AS top, n AS top_count
            FROM ({_top_sql(source, [n], 1)})"""
            for n in names
        ]
    )


@query("describe_categorical", f"WITH {DIRTY} " + _describe_categories_sql("dirty", ["Status-Code", "cust/text"]))
def _(spark, folder):
    return eda.describe_categorical(dirty_orders(spark, folder))


@query("describe_documents", _describe_categories_sql("documents", ["text", "lang", "source"]))
def _(spark, folder):
    return eda.describe_categorical(table(spark, folder, "documents"))


# --- text functions --------------------------------------------------------------------


@query(
    "normalize_name_expr",
    r"""SELECT page_id, CASE WHEN s = '' THEN 'column' ELSE s END AS name FROM (SELECT page_id, array_to_string(regexp_extract_all(
      regexp_replace(lower(url), '[^\p{L}\p{N}\s\-/\\_]', '', 'g'), '[\p{L}\p{N}]+'), '_') AS s FROM pages)""",
)
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", C.normalize_name_expr(F.col("url")).alias("name"))


@query(
    "safe_filename",
    r"""SELECT page_id, CASE WHEN s = '' THEN 'uploaded_data.csv' ELSE s END AS name FROM (SELECT page_id,
    regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '[^\p{L}\p{N}_.\-]+', '_', 'g') AS s FROM pages)""",
)
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", C.safe_filename(F.col("url")).alias("name"))


@query("file_suffix", r"SELECT page_id, lower(regexp_extract(url, '\.([^./]+)$', 1)) AS suffix FROM pages")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", C.file_suffix(F.col("url")).alias("suffix"))


@query("escape_cell", r"SELECT doc_id, md5(replace(replace(text, '|', '\|'), chr(10), ' ')) AS digest FROM documents")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(C.escape_cell(F.col("text"))).alias("digest"))


@query(
    "text_preview",
    r"""SELECT doc_id, length(p) AS n, md5(p) AS digest FROM (SELECT doc_id, regexp_replace(
      CASE WHEN strpos(text, chr(10)) BETWEEN 2 AND 4001 THEN substring(text, 1, strpos(text, chr(10)) - 1) ELSE substring(text, 1, 4000) END,
      '\s+$', '') AS p FROM documents)""",
)
def _(spark, folder):
    cut = C.text_preview(F.col("text"), heading="\n")
    return table(spark, folder, "documents").select("doc_id", cut.alias("p")).select(
        "doc_id", F.length("p").cast("bigint").alias("n"), F.md5("p").alias("digest")
    )


@query(
    "limited_names",
    """SELECT doc_id, md5(array_to_string(list_transform(w[1:12], lambda x: '`' || x || '`'), ', ') ||
      CASE WHEN len(w) > 12 THEN '，另有 ' || (len(w) - 12) || ' 项未展开' ELSE '' END) AS digest
    FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
def _(spark, folder):
    words = C.limited_names(F.split("text", " "))
    return table(spark, folder, "documents").select("doc_id", F.md5(words).alias("digest"))


# --- run log ---------------------------------------------------------------------------

EVENT_PAIRS = [
    ("view", "click"), ("view", "view"), ("click", "purchase"), ("signup", "view"), ("click", "view"), ("purchase", "view"),
]
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"


@query("latest_state", f"WITH {LATEST} SELECT user_id, event_id, event_type, value FROM latest")
def _(spark, folder):
    events = table(spark, folder, "events")
    return runlog.latest_state(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query(
    "recent_runs",
    f"""WITH {LATEST} SELECT l.user_id, c.created_at, l.event_id, l.event_type FROM latest l
    JOIN (SELECT user_id, min(ts) AS created_at FROM events GROUP BY user_id) c USING (user_id) ORDER BY created_at DESC, l.user_id LIMIT 20""",
)
def _(spark, folder):
    events = table(spark, folder, "events")
    return runlog.recent_runs(events, "user_id", ["ts", "event_id"]).select("user_id", "created_at", "event_id", "event_type")


@query("drop_runs", f"WITH {LATEST} SELECT event_id, user_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM latest WHERE event_type = 'error')")
def _(spark, folder):
    events = table(spark, folder, "events")
    gone = runlog.latest_state(events, "user_id", ["ts", "event_id"]).filter("event_type = 'error'")
    return runlog.drop_runs(events, gone, "user_id").select("event_id", "user_id", "event_type")


@query(
    "status_counts",
    f"""WITH {LATEST} SELECT count(*) AS total, count(*) FILTER (event_type IN ('view', 'click')) AS active,
    count(*) FILTER (event_type = 'purchase') AS completed FROM latest""",
)
def _(spark, folder):
    states = runlog.latest_state(table(spark, folder, "events"), "user_id", ["ts", "event_id"], ["event_type"])
    return runlog.status_counts(states, "event_type", ["view", "click"], "purchase")


@query(
    "invalid_transitions",
    f"""SELECT user_id, event_id, b AS from_status, event_type AS to_status FROM (SELECT *,
      lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
    WHERE b IS NOT NULL AND (b || '>' || event_type) NOT IN ({', '.join(f"'{a}>{b}'" for a, b in EVENT_PAIRS)})""",
)
def _(spark, folder):
    bad = runlog.invalid_transitions(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type", EVENT_PAIRS)
    return bad.select("user_id", "event_id", "from_status", "to_status")


@query(
    "stage_reached",
    """SELECT event_id, CAST((value >= 12)::INT + (value >= 32)::INT + (value >= 58)::INT + (value >= 72)::INT + (value >= 82)::INT AS INTEGER) AS stages,
    CASE WHEN value >= 82 THEN 'report' WHEN value >= 72 THEN 'models' WHEN value >= 58 THEN 'ols' WHEN value >= 32 THEN 'eda'
      WHEN value >= 12 THEN 'cleaning' ELSE 'waiting' END AS stage FROM events""",
)
def _(spark, folder):
    value = F.col("value")
    return table(spark, folder, "events").select(
        "event_id", runlog.stage_reached(value).alias("stages"), runlog.stage_name(value).alias("stage")
    )


@query("event_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def _(spark, folder):
    return table(spark, folder, "events").select("event_id", C.stamp(F.col("ts")).alias("stamp"))


@query(
    "duplicate_documents",
    """SELECT CAST((SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS BIGINT) AS duplicates""",
)
def _(spark, folder):
    return profile.duplicate_count(table(spark, folder, "documents").select("text", "lang", "source"))


@query("profile_documents", _profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"], ["bigint", "string", "string", "string", "bigint"]))
def _(spark, folder):
    return profile.profile_columns(table(spark, folder, "documents"))


@query(
    "density_curves_rows",
    f"""SELECT "column", 200::BIGINT AS points, round(min(v), 6) AS low, round(max(v), 6) AS high FROM (
      {_union([f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")])}) GROUP BY 1""",
)
def _(spark, folder):
    curves = eda.density_curves(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    ends = curves.groupBy("column").agg(F.count("*").alias("points"), F.round(F.min("x"), 6).alias("low"), F.round(F.max("x"), 6).alias("high"))
    return ends.select("column", "points", "low", "high")
