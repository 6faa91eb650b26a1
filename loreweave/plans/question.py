"""Queries that classify questions and audit answers, on texts composed from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import models
from ..functions import arithmetic as A
from ..functions import text as T
from ..operators import audit as D
from ..operators import graph as G
from ..sources.tables import table

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


QUESTION = """CASE o_orderkey % 8 WHEN 0 THEN concat('Calculate ', o_orderkey, ' minus ', o_custkey) WHEN 1 THEN concat('Supplier must file ', o_custkey, ' forms')
WHEN 2 THEN 'List all risk factors mentioned across all sections' WHEN 3 THEN 'Who are the signatories?' WHEN 4 THEN 'What is the revenue for Apple in Q1 2024?'
WHEN 5 THEN 'state-of-the-art tools?' WHEN 6 THEN concat('Give the sum of ', o_custkey) ELSE 'Compare the trend of q1 and q3 for each of the two parties, then reconcile' END"""


def alt(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


MATH = f"(regexp_matches(q, '[-+×÷/*]') OR (regexp_matches(lower(q), '{'|'.join(T.MATH_WORDS)}') AND len(regexp_extract_all(q, '\\b\\d+\\.?\\d*\\b')) >= 2))"
TYPE = f"CASE WHEN {MATH} THEN 'math' WHEN regexp_matches(q, '{T.PREDICATE}') THEN 'predicate' WHEN regexp_matches(q, '{alt(T.SYNTHESIS)}', 'i') THEN 'synthesis' ELSE 'factual' END"


def _questions(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(QUESTION).alias("q"))


@query(f"SELECT o_orderkey, {TYPE} AS question_type, (regexp_matches(q, '{alt(T.SYNTHESIS)}', 'i') OR len(regexp_split_to_array(trim(q), '\\s+')) > 15 OR regexp_matches(q, '{alt(T.COMPLEX)}', 'i')) AS complex FROM (SELECT o_orderkey, {QUESTION} AS q FROM orders)")
def question_type(spark, sf):
    q = _questions(spark, sf)
    return q.select("o_orderkey", T.question_type(F.col("q")).alias("question_type"), T.is_complex(F.col("q")).alias("complex"))


@query(f"SELECT o_orderkey, regexp_matches(q, '{alt(T.MULTI_ENTITY)}', 'i') AS multi_entity FROM (SELECT o_orderkey, {QUESTION} AS q FROM orders)")
def multi_entity(spark, sf):
    return _questions(spark, sf).select("o_orderkey", T.is_multi_entity(F.col("q")).alias("multi_entity"))


@query(f"SELECT o_orderkey, {MATH} AS needs_math FROM (SELECT o_orderkey, {QUESTION} AS q FROM orders)")
def needs_math(spark, sf):
    return _questions(spark, sf).select("o_orderkey", T.needs_math(F.col("q")).alias("needs_math"))


NAMED = "CASE o_orderkey % 3 WHEN 0 THEN array('Dr. Ada Voss', concat('Unit ', o_custkey), 'Unit 1', 'a', 'b', 'c', 'd', 'e', 'f', 'g') WHEN 1 THEN array('prof Lee') ELSE array() END"
ASKED = "CASE WHEN o_orderkey % 2 = 0 THEN concat('what does closing number ', o_custkey, ' require') ELSE 'who signed the Closing, lease' END"


@query(f"""WITH q AS (SELECT o_orderkey, {ASKED} AS q, CAST({NAMED.replace('array(', 'list_value(')} AS VARCHAR[]) AS named FROM orders),
k AS (SELECT o_orderkey, CASE WHEN len(named) = 0 THEN list_filter(string_split(q, ' '), lambda w: length(w) > 4) ELSE list_transform(list_concat(list_slice(named, 1, 8), list_filter(['Closing Date', 'Closing Conditions'], lambda e: NOT list_contains(named, e))), lambda n: regexp_replace(n, '^(mr|ms|mrs|dr|prof|mx)\\.*\\s+', '', 'i')) END AS k FROM q)
SELECT o_orderkey, i AS place, k[i] AS keyword FROM (SELECT o_orderkey, k, unnest(range(1, len(k) + 1)) AS i FROM k)""")
def query_expansion(spark, sf):
    """Names found in a question, 8 at most, and the expansions of its defined terms; without a name its longer words."""
    q = table(spark, sf, "orders").select("o_orderkey", F.expr(ASKED).alias("q"), F.expr(NAMED).cast("array<string>").alias("named"))
    return q.select("o_orderkey", F.posexplode(T.query_keywords(F.col("q"), F.col("named"), {"closing": ["Closing Date", "Closing Conditions"]})).alias("place", "keyword")).withColumn("place", F.col("place").cast("long") + 1)


ANSWER = "CASE o_orderkey % 4 WHEN 0 THEN concat('Costs fell due to churn of ', o_custkey) WHEN 1 THEN 'It rose Thanks to demand and because of price' WHEN 2 THEN 'No cause is given' ELSE 'This was caused by delay' END"
CONTEXT = "CASE WHEN o_orderkey % 8 < 4 THEN 'Plain facts' ELSE 'The drop was due to weather, because of rain' END"


@query(f"""SELECT o_orderkey, p AS phrase FROM (SELECT o_orderkey, lower({ANSWER}) AS a, lower({CONTEXT}) AS c, lower(CASE WHEN o_orderkey % 12 = 3 THEN 'What was caused by it?' ELSE 'Why?' END) AS q FROM orders),
(SELECT unnest([{', '.join(repr(x) for x in T.CAUSAL)}]) AS p) WHERE contains(a, p) AND NOT contains(c, p) AND NOT contains(q, p)""")
def fabrication_causal(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", F.lower(F.expr(ANSWER)).alias("a"), F.lower(F.expr(CONTEXT)).alias("c"), F.lower(F.expr("CASE WHEN o_orderkey % 12 = 3 THEN 'What was caused by it?' ELSE 'Why?' END")).alias("q"))
    return t.withColumn("phrase", F.explode(F.array(*[F.lit(x) for x in T.CAUSAL]))).where(F.col("a").contains(F.col("phrase")) & ~F.col("c").contains(F.col("phrase")) & ~F.col("q").contains(F.col("phrase"))).select("o_orderkey", "phrase")


CALC = "CASE o_orderkey % 4 WHEN 0 THEN '$1.5M-$0.5M=$1M' WHEN 1 THEN '$1.5M + $2.3M = $3.8M' WHEN 2 THEN concat(o_custkey, '-', 27, '=', o_custkey - 27) ELSE 'none' END"


GROUPS = ", ".join(f"regexp_extract_all(a, '{T.CALCULATION[4:]}', {g}, 'i') AS g{g}" for g in (1, 2, 3))
SHOWN = "CASE WHEN o_orderkey % 8 < 4 THEN a WHEN o_orderkey % 4 = 2 THEN 'other' ELSE a END"


@query(f"""WITH t AS (SELECT o_orderkey, a, {SHOWN} AS c FROM (SELECT o_orderkey, {CALC} AS a FROM orders)), g AS (SELECT o_orderkey, c, {GROUPS} FROM t)
SELECT o_orderkey, len(list_filter(range(1, len(g1) + 1), lambda i: NOT contains(c, g1[i] || '-' || g2[i] || '=' || g3[i]) AND NOT contains(c, g1[i] || ' - ' || g2[i] || ' = ' || g3[i])))::INTEGER AS n_invented FROM g""")
def invented_arithmetic(spark, sf):
    """Calculations of the answer that the context doesn't show; a negative result isn't read as one."""
    t = table(spark, sf, "orders").select("o_orderkey", F.expr(CALC).alias("a")).withColumn("c", F.expr(SHOWN))
    return t.select("o_orderkey", F.size(D.invented_sums(F.col("a"), F.col("c"))).alias("n_invented"))


SOURCE = """concat(CASE o_orderkey % 5 WHEN 0 THEN 'There is a Direct Conflict between A and B. ' WHEN 1 THEN 'The figure was revised TO 7. ' WHEN 2 THEN 'All agree. ' WHEN 3 THEN 'Readers are specifically advised of it. ' ELSE '' END,
CASE o_custkey % 6 WHEN 0 THEN 'It Should Be ' WHEN 1 THEN 'This must be reconciled with ' WHEN 2 THEN 'restated  as ' WHEN 3 THEN 'Amended to ' ELSE 'Equal to ' END, o_custkey)"""


def _says(items: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(c), '{x}')" for x in items) + ")"


@query(f"SELECT o_orderkey, CASE WHEN {_says(T.CONFLICT)} THEN 'documented_conflict' WHEN {_says(T.REVISION)} THEN 'revision' ELSE 'none' END AS contradiction FROM (SELECT o_orderkey, {SOURCE} AS c FROM orders)")
def contradiction_class(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.contradiction(F.expr(SOURCE)).alias("contradiction"))


TERM = """concat(CASE o_orderkey % 7 WHEN 0 THEN 'term = 2 years for ' WHEN 1 THEN 'a two-year lease ' WHEN 2 THEN 'twenty-four (24) months at ' WHEN 3 THEN '36-month plan ' WHEN 4 THEN 'FIVE year note ' WHEN 5 THEN 'twelve months, 12-month and one year ' ELSE 'two yearly ' END, o_custkey % 5,
CASE o_custkey % 4 WHEN 0 THEN '-year bond' WHEN 1 THEN ' year bond' WHEN 2 THEN ' years after thirty-six months' ELSE ' months' END)"""
NORMALISED = "t"
for _pattern, _months in T.DURATIONS:
    NORMALISED = f"regexp_replace({NORMALISED}, '{_pattern}', '{_months}_months', 'gi')"


@query(f"SELECT o_orderkey, {NORMALISED} AS normalised FROM (SELECT o_orderkey, {TERM} AS t FROM orders)")
def duration_norm(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.normalise_durations(F.expr(TERM)).alias("normalised"))


REFERENCE = "CASE o_orderkey % 4 WHEN 0 THEN concat('terms are summarized in Section ', o_custkey) WHEN 1 THEN concat('fee = ', o_custkey) WHEN 2 THEN concat('see above, fee = ', o_custkey) ELSE concat('sections = ', o_custkey) END"


@query(f"SELECT o_orderkey, p AS predicate FROM (SELECT o_orderkey, {REFERENCE} AS p FROM orders) WHERE NOT regexp_matches(p, '{alt(T.REFERENCES)}', 'i')")
def reference_filter(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(REFERENCE).alias("predicate")).where(~T.is_reference(F.col("predicate")))


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS grp, unnest(list_concat(list_transform(range(0, o_orderkey % 6), lambda i: concat('v', i, ' = v', i + 1, ' * ', o_custkey, ' if in ', 'w', i)), CASE WHEN o_custkey % 3 = 0 THEN [concat('v', o_orderkey % 6, ' = 2 + v0'), 'forall(x) = v0'] WHEN o_custkey % 3 = 1 THEN ['v0 = v0 + 1', 'v1 == v0'] ELSE ['exists = v0'] END)) AS p FROM orders),
e AS (SELECT DISTINCT grp, src, dst FROM (SELECT grp, regexp_extract(p, '^(\\w+)\\s*=\\s*(.+)$', 1) AS src, unnest(regexp_extract_all(regexp_extract(p, '^(\\w+)\\s*=\\s*(.+)$', 2), '\\b([a-zA-Z_]\\w*)\\b', 1)) AS dst FROM p WHERE NOT starts_with(p, 'forall') AND NOT starts_with(p, 'exists')) WHERE src <> '' AND src <> dst AND dst NOT IN ('if', 'in')),
r(grp, src, dst) AS (SELECT grp, src, dst FROM e UNION SELECT r.grp, r.src, e.dst FROM r JOIN e ON r.grp = e.grp AND r.dst = e.src) SELECT DISTINCT grp FROM r WHERE src = dst""")
def circular_definitions(spark, sf):
    """Groups of predicates whose definitions go round: edges from the name left of = to the names right of it."""
    p = F.expr("""concat(CASE WHEN o_orderkey % 6 > 0 THEN transform(sequence(0L, o_orderkey % 6 - 1), i -> concat('v', i, ' = v', i + 1, ' * ', o_custkey, ' if in ', 'w', i)) ELSE array() END,
CASE o_custkey % 3 WHEN 0 THEN array(concat('v', o_orderkey % 6, ' = 2 + v0'), 'forall(x) = v0') WHEN 1 THEN array('v0 = v0 + 1', 'v1 == v0') ELSE array('exists = v0') END)""")
    preds = table(spark, sf, "orders").select(F.col("o_orderkey").alias("grp"), F.explode(p).alias("p")).where(~F.lower(F.trim("p")).rlike(r"^(forall|exists|∀|∃|all\(|any\()"))
    left, right = F.regexp_extract(F.trim("p"), r"^(\w+)\s*=\s*(.+)$", 1), F.regexp_extract(F.trim("p"), r"^(\w+)\s*=\s*(.+)$", 2)
    edges = preds.select("grp", left.alias("src"), F.explode(F.regexp_extract_all(right, F.lit(r"\b([a-zA-Z_]\w*)\b"), F.lit(1))).alias("dst")).where((F.col("src") != "") & (F.col("src") != F.col("dst")) & ~F.col("dst").isin(T.DEFINITION_SKIP))
    return G.transitive_cycles(edges)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN greatest(0.0, least(s * 0.7, 0.75)) WHEN o_orderkey % 3 = 1 THEN greatest(0.05, least(s * 0.5, 0.5)) ELSE greatest(0.05, least(s, 0.95)) END::DOUBLE AS confidence
FROM (SELECT o_orderkey, round(o_totalprice / 50000.0 - 6, 4) AS s FROM orders)""")
def confidence_score(spark, sf):
    s = table(spark, sf, "orders").withColumn("s", F.round(F.col("o_totalprice") / 50000.0 - 6, 4))
    return s.select("o_orderkey", T.confidence(F.col("s"), F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 3 == 1).alias("confidence"))


PREDICATES = """CASE o_orderkey % 6 WHEN 0 THEN array('exists(r) where t(r) == 0', concat('ratio >= ', o_custkey), 'forall(r)') WHEN 1 THEN array('Zero defects', 'count > 0', 'EVERY unit') WHEN 2 THEN array('count >= 0', 'zero', 'all')
WHEN 3 THEN array('x = 1') WHEN 4 THEN array('a == 0', concat('b >= ', o_custkey % 3), 'all of them') ELSE array() END"""


@query(f"""SELECT o_orderkey, len(list_filter(p, lambda x: regexp_matches(lower(x), '==\\s*0|zero'))) > 0 AND len(list_filter(p, lambda x: regexp_matches(x, '>=\\s*[1-9]|>\\s*0'))) > 0 AND len(list_filter(p, lambda x: regexp_matches(lower(x), 'forall|all|every'))) > 0 AS inconsistent
FROM (SELECT o_orderkey, CAST({PREDICATES.replace('array(', 'list_value(')} AS VARCHAR[]) AS p FROM orders)""")
def zero_rule(spark, sf):
    """Some predicate says zero, some says at least one, and some speaks of all."""
    return table(spark, sf, "orders").select("o_orderkey", D.inconsistent(F.expr(PREDICATES).cast("array<string>")).alias("inconsistent"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_custkey - 27 WHEN 1 THEN (o_custkey + 76.5) * 3 - 27 / 2.0 WHEN 2 THEN o_custkey / nullif(o_orderkey % 4, 0)::DOUBLE WHEN 3 THEN -(o_custkey - 2) + 0.25 WHEN 4 THEN NULL ELSE 12 * o_custkey - 3 END::DOUBLE AS value FROM orders""")
def math_answers(spark, sf):
    """Values of expressions on a small grammar; what isn't one, and a division by zero, has none. Nothing is run as code."""
    e = F.expr("""CASE o_orderkey % 6 WHEN 0 THEN concat(o_custkey, ' - 27') WHEN 1 THEN concat('(', o_custkey, '+76.5)*3-27/2') WHEN 2 THEN concat(o_custkey, ' / ', o_orderkey % 4) WHEN 3 THEN concat('-(', o_custkey, ' - 2) + .25')
WHEN 4 THEN concat('__import__("os").system(', o_custkey, ')') ELSE concat('rate * ', o_custkey, ' - fee') END""")
    names = F.create_map(F.lit("rate"), F.lit(12.0), F.lit("fee"), F.lit(3.0))
    return table(spark, sf, "orders").select("o_orderkey", A.calculated(e, names).alias("value"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey - 27 WHEN 1 THEN 1200 - o_custkey WHEN 2 THEN o_custkey * 4 + 1 WHEN 3 THEN (88 + 76 + o_custkey - 27) ELSE NULL END::DOUBLE AS value FROM orders""")
def math_questions(spark, sf):
    """What questions ask to calculate, in words or signs; other questions have no value."""
    q = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN concat('What is ', o_custkey, ' minus 27?') WHEN 1 THEN concat('Subtract ', o_custkey, ' from 1,200 please') WHEN 2 THEN concat('Compute ', o_custkey, ' times 4 plus 1.')
WHEN 3 THEN concat('What is (88+76+', o_custkey, '−27)?') ELSE 'What is the capital of France?' END""")
    return table(spark, sf, "orders").select("o_orderkey", A.calculated(A.spoken_expression(q)).alias("value"))


AUDITED = """CASE o_orderkey % 7 WHEN 0 THEN concat('The figure ', o_custkey, ' was not found') WHEN 1 THEN 'It fell due to churn' WHEN 2 THEN concat('So ', o_custkey, '-1=', o_custkey * 2) WHEN 3 THEN 'All is well'
WHEN 4 THEN concat('The total is ', o_custkey) WHEN 5 THEN 'It rose because of demand' ELSE 'No count is given' END"""
EVIDENCE = """CASE o_orderkey % 4 WHEN 0 THEN concat('Total ', o_custkey, ' as there is a direct conflict between A and B') WHEN 1 THEN 'It rose because of demand, later revised to 7' ELSE 'Plain facts' END"""


@query(f"""WITH t AS (SELECT o_orderkey, o_custkey, {AUDITED} AS a, {EVIDENCE} AS c, o_orderkey % 3 = 0 AS p FROM orders),
f AS (SELECT *, (o_orderkey % 7 = 1 OR (o_orderkey % 7 = 5 AND NOT contains(c, 'because of')) OR o_orderkey % 7 = 2) AS bad, regexp_extract_all(a, '[0-9]+') AS nums FROM t),
g AS (SELECT *, CASE WHEN contains(lower(a), 'not found') THEN 'no_answer' WHEN bad THEN 'fabrication' WHEN p THEN 'constraint' ELSE 'model' END AS gate FROM f)
SELECT o_orderkey, gate, gate = 'constraint' AND contains(c, 'direct conflict') AS has_contradiction, CASE gate WHEN 'no_answer' THEN false WHEN 'fabrication' THEN true WHEN 'constraint' THEN NOT contains(c, 'direct conflict')
ELSE len(list_filter(nums, lambda n: NOT contains(substr(c, 1, 6000), n))) > 0 END AS rejected FROM g""")
def audit_gates(spark, sf):
    """Which gate decides on an answer, and whether it is sent back; the model's opinion is a stub."""
    t = table(spark, sf, "orders").select("o_orderkey", F.lit("Why?").alias("question"), F.when(F.col("o_orderkey") % 3 == 0, "predicate").otherwise("factual").alias("question_type"), F.expr(AUDITED).alias("answer"), F.expr(EVIDENCE).alias("context"), F.array(F.lit("a == 0"), F.lit("b > 0"), F.lit("for all")).alias("predicates"))
    out = D.gates(t, models.stub_opinion(F.col("answer"), F.col("context")))
    return out.select("o_orderkey", "gate", "has_contradiction", F.col("feedback").isNotNull().alias("rejected"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1 ELSE 2 END AS attempts, CASE o_orderkey % 3 WHEN 0 THEN 'It is 7' WHEN 1 THEN concat('Again: ', o_custkey) ELSE 'It fell due to churn' END AS answer, o_orderkey % 3 = 2 AS rejected FROM orders""")
def second_attempt(spark, sf):
    """Answers that are sent back are given once more; what is then still sent back stays so."""
    t = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Q"), (F.col("o_orderkey") % 3).cast("string")).alias("question"), F.lit("factual").alias("question_type"), F.concat(F.lit("7 and "), F.col("o_custkey").cast("string")).alias("context"), F.array().cast("array<string>").alias("predicates"))

    def generate(question, context, feedback):
        return F.when(question == "Q0", "It is 7").when((question == "Q1") & feedback.isNotNull(), F.concat(F.lit("Again: "), F.split_part(context, F.lit(" "), F.lit(3)))).when(question == "Q1", "It was caused by delay").otherwise("It fell due to churn")

    out = D.answered(t, generate, F.lit("pass"))
    return out.select("o_orderkey", "attempts", "answer", F.col("feedback").isNotNull().alias("rejected"))


@query("SELECT role AS provider, sum(length(text) // 4)::BIGINT AS prompt_tokens, sum(turn)::BIGINT AS completion_tokens, sum(length(text) // 4 + turn)::BIGINT AS total_tokens, count(*) AS calls FROM conversations GROUP BY role")
def token_usage(spark, sf):
    return D.token_usage(table(spark, sf, "conversations").select(F.col("role").alias("provider"), F.floor(F.length("text") / 4).cast("long").alias("prompt_tokens"), F.col("turn").cast("long").alias("completion_tokens")))


@query("SELECT conv_id, turn, CASE WHEN length(text) BETWEEN 3 AND 2000 AND length(trim(text)) > 0 THEN md5(trim(text)) END AS question FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN concat(' ', text, ' ') WHEN 1 THEN substr(text, 1, 2) ELSE repeat(text, 9) END AS text FROM conversations)")
def valid_requests(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.expr("CASE turn % 3 WHEN 0 THEN concat(' ', text, ' ') WHEN 1 THEN substr(text, 1, 2) ELSE repeat(text, 9) END").alias("text"))
    return c.select("conv_id", "turn", F.md5(T.valid_question(F.col("text"))).alias("question"))
