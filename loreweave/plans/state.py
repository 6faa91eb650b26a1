"""Queries of job state, dashboard, history and file search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import state as S
from ..sources.tables import table

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


STATE = """ev AS (SELECT *, CASE event_type WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' END AS status FROM events),
last AS (SELECT user_id, status, ts, CASE status WHEN 'processing' THEN 604800 WHEN 'completed' THEN 2592000 WHEN 'failed' THEN 604800 WHEN 'cancelled' THEN 172800 END AS ttl_seconds
FROM ev WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


@query(f"WITH {STATE} SELECT user_id, status, ts, ttl_seconds::BIGINT AS ttl_seconds FROM last")
def job_state_latest(spark, sf):
    return S.latest(table(spark, sf, "events"))


@query(f"WITH {STATE} SELECT user_id, status, epoch(TIMESTAMP '2024-02-05' - ts) > ttl_seconds AS expired FROM last")
def job_state_ttl(spark, sf):
    return S.expired(S.latest(table(spark, sf, "events")), F.expr("timestamp'2024-02-05'")).select("user_id", "status", "expired")


@query(f"WITH {STATE} SELECT user_id, status, ts, ttl_seconds::BIGINT AS ttl_seconds FROM last")
def job_state_stream(spark, sf):
    """The stream's states after all events; must equal the batch twin. Its files lie in the shared folder."""
    from ..staging import fresh_path
    from ..streaming.jobs import run_available

    base = fresh_path(spark, "jobs")
    return run_available(spark, f"{sf}/events.parquet", f"{base}/out", f"{base}/checkpoint")


@query(f"WITH {STATE} SELECT status, count(*) AS n FROM last GROUP BY status")
def status_counts(spark, sf):
    return S.latest(table(spark, sf, "events")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {STATE} SELECT count(*) FILTER (status = 'processing') AS active FROM last")
def active_jobs(spark, sf):
    return S.latest(table(spark, sf, "events")).agg(F.count_if(F.col("status") == "processing").alias("active"))


FILES = f"""{STATE}, f AS (SELECT source AS filename, sum(n_chars)::BIGINT AS size, min(doc_id) AS first_doc FROM documents GROUP BY source),
j AS (SELECT filename, size, coalesce(status, 'completed') AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS uploaded_at FROM f LEFT JOIN last ON user_id = first_doc + 1)"""


def _listing(spark, sf) -> DataFrame:
    files = table(spark, sf, "documents").groupBy(F.col("source").alias("filename")).agg(F.sum("n_chars").alias("size"), F.min("doc_id").alias("first_doc"))
    states = S.latest(table(spark, sf, "events")).select((F.col("user_id") - 1).alias("first_doc"), "status", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("uploaded_at"))
    named = files.join(states, "first_doc").select("filename", "status", "uploaded_at")
    return S.listing(files.select("filename", "size"), named).select("filename", "size", "status", "uploaded_at")


@query(f"WITH {FILES} SELECT filename, size, status, uploaded_at FROM j ORDER BY coalesce(uploaded_at, '0000') DESC, filename")
def documents_listing(spark, sf):
    return _listing(spark, sf)


@query(f"WITH {FILES} SELECT count(*) AS documents, sum(size)::BIGINT AS total_size, count(*) FILTER (status = 'completed') AS completed, round(sum(size) / 1024.0, 1) AS size_kb, max(uploaded_at) AS newest FROM j")
def dashboard_overview(spark, sf):
    size = F.sum("size")
    return _listing(spark, sf).agg(F.count("*").alias("documents"), size.alias("total_size"), F.count_if(F.col("status") == "completed").alias("completed"), F.round(size / F.lit(1024.0), 1).alias("size_kb"), F.max("uploaded_at").alias("newest"))


@query(f"WITH {FILES} SELECT filename, row_number() OVER (ORDER BY size, filename) AS by_size, row_number() OVER (ORDER BY coalesce(uploaded_at, '0') DESC, filename) AS by_date, row_number() OVER (ORDER BY lower(filename), filename) AS by_name FROM j")
def sort_documents(spark, sf):
    """Places of the files (one row for each source) in the three orders of the listing."""
    d = _listing(spark, sf)
    orders = {"by_size": [F.coalesce("size", F.lit(0))], "by_date": [F.coalesce("uploaded_at", F.lit("0")).desc()], "by_name": [F.lower("filename")]}
    out = d.select("filename")
    for name, keys in orders.items():
        out = out.join(S.placed(d, [*keys, F.col("filename")], name).select("filename", name), "filename")
    return out


@query("SELECT conv_id, turn, role, back <= 2 AS server_window FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6")
def history_last_n(spark, sf):
    return R.last_turns(table(spark, sf, "conversations"), "conv_id", "turn", 6).select("conv_id", "turn", "role", (F.col("back") <= 2).alias("server_window"))


NAMES = "SELECT DISTINCT source AS filename FROM documents UNION SELECT DISTINCT p_name FROM part"
TERMS = ["src1", "green metal", "ed"]


def _prox(w: str) -> str:
    """Letters found one after the other, written out as nested lists for a fixed word."""
    at, score, ok = "0", [], []
    for i, c in enumerate(w):
        here = f"(CASE WHEN instr(substr(name, ({at}) + 1), '{c}') > 0 THEN ({at}) + instr(substr(name, ({at}) + 1), '{c}') ELSE ({at}) END)"
        ok.append(f"instr(substr(name, ({at}) + 1), '{c}') > 0")
        if i:
            score.append(f"greatest(0, 10 - ({here} - ({at})))")
        at = here
    return f"(CASE WHEN {' AND '.join(ok)} THEN {' + '.join(score) or '0'} ELSE 0 END)"


def _score(term: str) -> str:
    words = term.split()
    lead = " + ".join(f"coalesce(list_sum([CASE WHEN starts_with(x, '{w}') THEN 100 - (i - 1) * 10 ELSE 0 END for x, i in regexp_split_to_array(name, '[\\s_.-]+')]), 0) + CASE WHEN contains(name, '{w}') THEN 50 ELSE 0 END" for w in words)
    return f"CASE WHEN name = '{term}' THEN 1000 ELSE 0 END + CASE WHEN starts_with(name, '{term}') THEN 500 ELSE 0 END + CASE WHEN contains(name, '{term}') THEN 200 ELSE 0 END + {lead}"


@query("SELECT filename, term, round(score, 6) AS score FROM (" + " UNION ALL ".join(f"SELECT filename, '{t}' AS term, ({_score(t)})::DOUBLE + {' + '.join(f'10 * {_prox(w)}' for w in t.split() if len(w) <= 5)} - length(name) * 0.1::DOUBLE AS score FROM (SELECT filename, lower(filename) AS name FROM ({NAMES}))" for t in TERMS) + ") WHERE score > 0")
def smart_search(spark, sf):
    names = table(spark, sf, "documents").select(F.col("source").alias("filename")).union(table(spark, sf, "part").select("p_name")).distinct()
    scored = names.select("filename", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), T.search_score(F.col("filename"), t).alias("score")) for t in TERMS])).alias("s")).select("filename", "s.term", F.round("s.score", 6).alias("score"))
    return scored.where("score > 0")


@query(f"SELECT filename, {_prox('rep')} AS rep, {_prox('sr1')} AS sr1 FROM (SELECT filename, lower(filename) AS name FROM ({NAMES}))")
def char_proximity(spark, sf):
    names = table(spark, sf, "documents").select(F.col("source").alias("filename")).union(table(spark, sf, "part").select("p_name")).distinct()
    return names.select("filename", T.proximity(F.lower("filename"), F.lit("rep")).alias("rep"), T.proximity(F.lower("filename"), F.lit("sr1")).alias("sr1"))


@query("""SELECT DISTINCT p_name, CASE WHEN instr(lower(p_name), 'e') > 0 THEN substr(p_name, 1, instr(lower(p_name), 'e') - 1) || '<mark>' || substr(p_name, instr(lower(p_name), 'e'), 1) || '</mark>' || substr(p_name, instr(lower(p_name), 'e') + 1) ELSE p_name END AS marked,
regexp_replace(regexp_replace(p_name, '(?i)^(.*?)(st)', '\\1<mark>\\2</mark>'), '(?i)^(.*?)(ee)', '\\1<mark>\\2</mark>') AS by_word FROM part""")
def highlight_match(spark, sf):
    """The term's first occurrence marked, or else the first of each of its words."""
    p = table(spark, sf, "part").select("p_name").distinct()
    return p.withColumn("marked", T.highlight(F.col("p_name"), "E")).withColumn("by_word", T.highlight(F.col("p_name"), "ST  ee"))


@query("SELECT o_orderkey, CASE WHEN c > 0.7 THEN 'green' WHEN c > 0.3 THEN 'yellow' ELSE 'red' END AS band FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS c FROM orders)")
def confidence_band(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.confidence_band((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("band"))


@query("SELECT doc_id, source AS file, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id % 50 AS VARCHAR) END AS page, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE concat(doc_id, '-', doc_id + 2) END AS page_range FROM documents")
def citation_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit(":"), (F.col("doc_id") % 50).cast("string")))).alias("cite"))
    return d.select("doc_id", F.split_part("cite", F.lit(":"), F.lit(1)).alias("file"), F.split_part("cite", F.lit(":"), F.lit(2)).alias("page"), T.page_range(F.col("doc_id"), F.col("doc_id") + (F.col("doc_id") % 2) * 2).alias("page_range"))


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_turn FROM conversations")
def carry_forward(spark, sf):
    """The last value seen, as section titles are carried over elements."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("last_user_turn"))


@query("SELECT quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic")
def label_evaluation(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


UPDATES = """u AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' END AS status,
CASE WHEN event_type = 'signup' THEN concat('task', event_id) END AS task_id, CASE WHEN event_type = 'signup' THEN concat('t', event_id) END AS uploaded_at,
CASE event_type WHEN 'signup' THEN '' WHEN 'purchase' THEN concat('c', event_id) WHEN 'error' THEN concat('c', event_id) WHEN 'click' THEN concat('c', event_id) END AS completed_at,
CASE event_type WHEN 'signup' THEN '' WHEN 'error' THEN repeat(concat('e', event_id), 200) END AS error FROM events WHERE event_type <> 'view')"""
LAST = ", ".join(f"arg_max({c}, struct_pack(ts, event_id)) FILTER ({c} IS NOT NULL) AS {c}" for c in ("task_id", "status", "uploaded_at", "completed_at", "error"))


def _updates(spark, sf) -> DataFrame:
    """What each event writes: an upload all fields, the others their own."""
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    ended = kind.isin("purchase", "error", "click")
    return S.with_status(table(spark, sf, "events")).select(
        "user_id", "ts", "event_id", "status", F.when(kind == "signup", F.concat(F.lit("task"), n)).alias("task_id"), F.when(kind == "signup", F.concat(F.lit("t"), n)).alias("uploaded_at"),
        F.when(kind == "signup", "").when(ended, F.concat(F.lit("c"), n)).alias("completed_at"), F.when(kind == "signup", "").when(kind == "error", F.repeat(F.concat(F.lit("e"), n), 200)).alias("error"),
    )


@query(f"WITH {UPDATES}, x AS (SELECT user_id, {LAST} FROM u GROUP BY user_id) SELECT user_id, task_id, status, uploaded_at, nullif(completed_at, '') AS completed_at, nullif(substr(error, 1, 500), '') AS error FROM x")
def job_fields(spark, sf):
    """The hash of each job after partial updates: a field keeps its last value that was written."""
    return S.fields(_updates(spark, sf), "user_id", ["ts", "event_id"]).drop("ttl_seconds")


@query(f"WITH {STATE} SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM last WHERE status = 'cancelled') GROUP BY user_id")
def cancel_cleanup(spark, sf):
    """What is left of running work once cancelled keys are dropped."""
    ev = table(spark, sf, "events")
    return S.cancelled_removed(ev, S.latest(ev), "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"WITH {STATE} SELECT user_id, status FROM last WHERE user_id % 10 <> 3")
def state_delete(spark, sf):
    """States without the exact keys that were deleted."""
    states = S.latest(table(spark, sf, "events"))
    return S.without(states, states.where("user_id % 10 = 3"), "user_id").select("user_id", "status")


@query(f"""WITH {STATE} SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILURE' END AS task_status, status FROM last WHERE user_id % 3 < 2 AND status <> 'processing'""")
def terminal_reconciliation(spark, sf):
    """Uploads that are over: the task ended, and the document's state says so too."""
    states = S.latest(table(spark, sf, "events"))
    tasks = states.select("user_id", F.expr("CASE user_id % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILURE' ELSE 'STARTED' END").alias("task_status"))
    return S.settled(tasks, states, "user_id")


@query(f"WITH {FILES} SELECT filename, status FROM j ORDER BY coalesce(uploaded_at, '0000') DESC, filename LIMIT 8")
def recent_documents(spark, sf):
    return S.recent(_listing(spark, sf)).select("filename", "status")


@query(f"WITH {FILES} SELECT filename FROM j WHERE status = 'completed'")
def completed_files(spark, sf):
    return S.select_completed(_listing(spark, sf))


@query(f"WITH {FILES} SELECT filename, status FROM j WHERE filename IN ('src1', 'src4')")
def summary_selection(spark, sf):
    return S.shown_in_summary(_listing(spark, sf), ["src1", "src4"]).select("filename", "status")


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['a', 'b', 'c', role] ELSE ['a'] END AS selected FROM conversations")
def toggle_selection(spark, sf):
    """A file that is selected is taken out, another one is added at the end."""
    held = F.expr("CASE turn % 3 WHEN 0 THEN array('a', role, 'b') WHEN 1 THEN array('a', 'b', 'c') ELSE array('a', role) END")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.toggled(held, F.col("role")).alias("selected"))


@query("SELECT CASE WHEN bool_and(r_regionkey <> 2) THEN 'healthy' ELSE 'degraded' END AS status, list(concat(r_name, '=', CASE WHEN r_regionkey = 2 THEN 'error' ELSE 'ok' END) ORDER BY concat(r_name, '=', CASE WHEN r_regionkey = 2 THEN 'error' ELSE 'ok' END)) AS checks FROM region")
def health_report(spark, sf):
    return S.health(table(spark, sf, "region").select(F.col("r_name").alias("service"), F.when(F.col("r_regionkey") == 2, "error").otherwise("ok").alias("result")))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE o_custkey % 600 = 429 OR o_custkey % 600 >= 500 END AS retryable FROM orders")
def retryable_failures(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'value' WHEN 1 THEN 'timeout' WHEN 2 THEN 'connection' ELSE 'http' END")
    return o.select("o_orderkey", T.is_retryable(kind, F.when(F.col("o_orderkey") % 4 == 3, F.col("o_custkey") % 600)).alias("retryable"))
