"""Scalar text functions as Column expressions; patterns are Java regular expressions."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that fix which questions, answers and names are recognised.
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
QUARTERS = ["first", "second", "third", "fourth"]
MATH_WORDS = ["calculate", "compute", "sum", "subtract", "add", "divide", "multiply", "ratio", "percentage", "total", "average", "mean", "difference", "reconcile", "derive", "net"]
PREDICATE = r"(?i)\bmust\b|\bshall\b|shall\s+not\b|cannot\b|required\s+to\b|forall\s*\(|∀|∃|>=|<=|!=|==|>|<"
SYNTHESIS = [
    r"\blist\s+(all|every|each)\b", r"\b(all|every|each)\s+\w+\s+(of|from|across|in)\b",
    r"\b(three|four|five|multiple)\b.{0,40}\b(commitment|payment|condition|person|risk)\b",
    r"\bseparate\b.{0,30}\b(amount|figure|value|payment)\b", r"\bacross\b.{0,30}\b(section|document|report)\b", r"\btotal.{0,20}(all|each|every)\b",
]
MULTI_ENTITY = [
    r"\b(both|two|three|four)\b.{0,40}\b(executive|person|employee|team|party|parties|director|shareholder)\b",
    r"\beach\s+of\b", r"\bthe\s+signatories\b", r"\beither\s+party\b", r"\ball\s+(three|four|named|listed)\b", r"\bwho\s+are\s+(the|all)\b",
]
COMPLEX = [
    r"\bcompare\b", r"\btrend\b", r"\breconcile\b", r"\bderive\b", r"\bcalculate\b", r"\bacross\b", r"\bbetween\b", r"\bmultiple\b",
    r"\bq[1-4]\b.*\bq[1-4]\b", r"\b(first|second|third).*(then|after|subsequently)\b",
]
CAUSAL = ["due to", "because of", "as a result of", "caused by", "owing to", "on account of", "thanks to", "attributable to"]
CONFLICT = [
    "notice of material inconsistency", "direct conflict between", "conflict exists between", "must be reconciled", "does not explain this discrepancy", "readers are specifically advised", "must resolve this inconsistency",
]
REVISION = [
    "revised to", "corrected to", "restated as", "superseded by", "amended to", "updated to", "replaced with", "should be", "actually is",
    "the correct value is", "error was", "mistake was",
]
REFERENCES = [
    r"\bsection\s+\d", r"\bpage\s+\d", r"\bappendix\b", r"\bsee\s+(section|page|above|below)\b", r"summarized\s+in\s+section",
    r"described\s+in\s+section", r"outlined\s+in\s+section", r"refer\s+to\s+section",
]
DURATIONS = [
    (r"\btwo[\s-]year\w*\b", "24"), (r"\b2[\s-]year\w*\b", "24"), (r"\btwenty[\s-]four\s*\(?\s*24\s*\)?\s*month\w*\b", "24"),
    (r"\btwenty[\s-]four\s*month\w*\b", "24"), (r"\b24[\s-]month\w*\b", "24"), (r"\bone[\s-]year\w*\b", "12"), (r"\b1[\s-]year\w*\b", "12"),
    (r"\btwelve\s*month\w*\b", "12"), (r"\b12[\s-]month\w*\b", "12"), (r"\bthree[\s-]year\w*\b", "36"), (r"\b3[\s-]year\w*\b", "36"),
    (r"\bthirty[\s-]six\s*month\w*\b", "36"), (r"\b36[\s-]month\w*\b", "36"), (r"\bfive[\s-]year\w*\b", "60"), (r"\b5[\s-]year\w*\b", "60"),
]
AMOUNT = r"([\$€£]?\s*[\d,]+\.?\d*\s*[MBK%]?)"
CALCULATION = rf"(?i){AMOUNT}\s*[-+*/×÷]\s*{AMOUNT}\s*=\s*{AMOUNT}"
DEFINITION_SKIP = ["if", "else", "and", "or", "not", "in", "True", "False", "None", "forall", "exists"]
MIME = {
    ".pdf": "application/pdf", ".txt": "text/plain", ".md": "text/markdown", ".html": "text/html", ".htm": "text/html",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
UPLOADS = ["pdf", "docx", "txt", "md", "html", "htm"]
CREDENTIALS = r",\s*[A-Z][A-Za-z\-.]+(?:\s*,\s*[A-Z][A-Za-z\-.]+)*$"
DEFINITIONS = [
    r"\((?:the\s+)?[\"“”‘’]([A-Z][a-zA-Z\s\-]+)[\"“”‘’]\)", r"hereinafter\s+(?:referred\s+to\s+as\s+)?[\"“”]([^\"”]+)[\"“”]",
    r"\(collectively[,\s]+(?:the\s+)?[\"“”]([^\"”]+)[\"“”]\)", r"[\"“]([A-Z][a-zA-Z\s\-]+)[\"”]\s*(?:means|shall mean|refers to)",
]
DEFINITION_HEADER = r"(article\s+i\b|section\s+1\b|definitions|defined terms|appendix\s+[a-z])"
KEY_SECTIONS = ["Conclusion", "Key Takeaways", "Summary", "Recommendation"]
GRAPH_MARK = "GRAPH CONNECTIONS"
TIERS = [("small", 500), ("medium", 2000)]

#: Expansions of defined terms by single lower-case word; callers bring their own documents' terms.
EXPANSIONS: dict[str, list[str]] = {"closing": ["Closing Date", "Closing Conditions"]}
TTL_DAYS = {"processing": 7, "completed": 30, "failed": 7, "cancelled": 2}


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def tokens(text: Column) -> Column:
    """ASCII words that aren't part of a longer Unicode word."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z0-9]+$"))


def point_id(source: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("::", source, text))


def text_fingerprint(text: Column) -> Column:
    return F.md5(F.substring(text, 1, 200))


def file_hash(content: Column, length: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the size and the first 64 KB."""
    return F.substring(F.sha2(F.concat(length.cast("string").cast("binary"), F.substring(content, 1, 65536)), 256), 1, 16)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(name), " -", "__"), "[^a-z0-9_]", "")


def edge_type(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def alias_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.lower(name)), "^the ", ""))


def strip_honorific(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"(?i)^(mr|ms|mrs|dr|prof|mx)\.*\s+", "")


def strip_credentials(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, CREDENTIALS, ""))


def period(header: Column) -> Column:
    """First hit of quarter, month, fiscal year and spelled quarter; null if none."""
    got = lambda p, g: F.nullif(F.regexp_extract(header, "(?i)" + p, g), F.lit(""))
    q, m, y = r"\bQ([1-4])\s*(?:FY|CY)?\s*(20\d{2})\b", rf"\b({MONTHS})\s*(20\d{{2}})\b", r"\bFY\s*(20\d{2})\b"
    w = r"\b(First|Second|Third|Fourth)\s+Quarter\s+(20\d{2})\b"
    number = F.array_position(F.array(*[F.lit(x) for x in QUARTERS]), F.lower(got(w, 1)))
    return F.coalesce(F.concat(F.lit("Q"), got(q, 1), F.lit("-"), got(q, 2)), F.concat(F.upper(F.substring(got(m, 1), 1, 3)), F.lit("-"), got(m, 2)), F.concat(F.lit("FY-"), got(y, 1)), F.concat(F.lit("Q"), number.cast("string"), F.lit("-"), got(w, 2)))


def section(markdown: Column) -> Column:
    """The last second-level header after the last first-level one, else that one, else General."""
    lines = F.transform(F.split(markdown, r"\r?\n"), lambda x: F.trim(x))
    heads = F.filter(lines, lambda x: x.rlike(r"^##? "))
    tops = F.transform(heads, lambda x: x.startswith("# "))
    name = lambda x: F.nullif(F.trim(F.regexp_replace(x, r"^[# ]+", "")), F.lit(""))
    after = F.slice(heads, F.greatest(F.size(heads) - F.array_position(F.reverse(tops), F.lit(True)).cast("int") + 1, F.lit(1)), F.greatest(F.size(heads), F.lit(1)))
    h1 = F.try_element_at(F.filter(heads, lambda x: x.startswith("# ")), F.lit(-1))
    h2 = F.try_element_at(F.filter(F.when(F.array_contains(tops, True), after).otherwise(heads), lambda x: x.startswith("## ")), F.lit(-1))
    return F.coalesce(name(h2), name(h1), F.lit("General"))


def is_markdown_table(text: Column) -> Column:
    rows = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\|.+\|"))
    return (F.size(rows) >= 2) & F.exists(rows, lambda x: x.rlike(r"^\|[\s\-|:]+\|"))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1))


def mime(filename: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(filename)), F.lit("application/octet-stream"))


def is_upload(filename: Column) -> Column:
    return F.substring(extension(filename), 2, 10).isin(UPLOADS)


def needs_math(question: Column) -> Column:
    """A sign of arithmetic, or a word of it (as part of any word) and two free-standing numbers."""
    signs = question.rlike(r"[-+×÷/*]")
    return signs | (F.lower(question).rlike("|".join(MATH_WORDS)) & (F.size(F.regexp_extract_all(question, F.lit(r"\b\d+\.?\d*\b"), F.lit(0))) >= 2))


def question_type(question: Column) -> Column:
    return F.when(needs_math(question), "math").when(question.rlike(PREDICATE), "predicate").when(question.rlike(any_of(SYNTHESIS)), "synthesis").otherwise("factual")


def is_multi_entity(question: Column) -> Column:
    return question.rlike(any_of(MULTI_ENTITY))


def is_complex(question: Column) -> Column:
    return question.rlike(any_of(SYNTHESIS)) | (F.size(F.split(F.trim(question), r"\s+")) > 15) | question.rlike(any_of(COMPLEX))


def normalise_durations(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, "(?i)" + p[0], f"{p[1]}_months"), DURATIONS, text)


def is_reference(predicate: Column) -> Column:
    return predicate.rlike(any_of(REFERENCES))


def contradiction(context: Column, conflict: list[str] | None = None) -> Column:
    """How the source speaks of a contradiction; ``conflict`` are more phrases that document one, such as those that name a party."""
    has = lambda items: reduce(lambda a, b: a | b, [F.lower(context).contains(x) for x in items])
    return F.when(has([*CONFLICT, *(conflict or [])]), "documented_conflict").when(has(REVISION), "revision").otherwise("none")


def confidence(score: Column, contradicted: Column, feedback: Column) -> Column:
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(x, F.lit(hi)))
    return F.when(contradicted, clip(score * 0.7, 0.0, 0.75)).when(feedback, clip(score * 0.5, 0.05, 0.5)).otherwise(clip(score, 0.05, 0.95))


def confidence_band(x: Column) -> Column:
    return F.when(x > 0.7, "green").when(x > 0.3, "yellow").otherwise("red")


def line_density(line: Column) -> Column:
    """Twice the numbers in a line, and five for a sign of money, a magnitude or a decimal."""
    return 2 * F.size(F.regexp_extract_all(line, F.lit(r"\d+\.?\d*"), F.lit(0))) + F.when(line.rlike(r"[$€£%]|\d+[MBK]|\d+\.\d+"), 5).otherwise(0)


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def strip_system_note(answer: Column) -> Column:
    return F.trim(F.regexp_replace(answer, r"\[[^\]]*SYSTEM NOTE:[^\]]*TRUSTED CODE EXECUTION RESULT[^\]]*\]", ""))


def json_list(text: Column) -> Column:
    """The array of strings between the first [ and the last ], without code fences; empty if there is none."""
    plain = F.regexp_replace(text, "```(?:json)?", "")
    return F.coalesce(F.from_json(F.regexp_extract(plain, r"(?s)(\[.*\])", 1), "array<string>"), F.array().cast("array<string>"))


def page_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def proximity(text: Column, word: Column) -> Column:
    """Sum of 10 less the gap (0 at least) between letters found one after the other; 0 unless all are found."""
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("score"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        at = F.call_function("locate", c, text, acc["last"] + 1)
        gained = F.when((at > 0) & (acc["last"] > 0), F.greatest(F.lit(0), 10 - (at - acc["last"]))).otherwise(0)
        return F.struct(F.when(at > 0, at).otherwise(acc["last"]).alias("last"), (acc["score"] + gained).alias("score"), (acc["n"] + (at > 0).cast("int")).alias("n"))

    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, start, step, lambda a: F.when(a["n"] == F.length(word), a["score"]).otherwise(0))


def search_score(filename: Column, term: str) -> Column:
    """Rank of a file name for a term: exact, leading, contained, by word, and by letters close together."""
    name, term = F.lower(filename), term.lower().strip()
    score = F.when(name == term, 1000).otherwise(0) + F.when(name.startswith(term), 500).otherwise(0) + F.when(name.contains(term), 200).otherwise(0)
    parts = F.split(name, r"[\s_.-]+")
    for word in term.split():
        score = score + _lead(parts, word) + F.when(name.contains(word), 50).otherwise(0) + proximity(name, F.lit(word)) * 10
    return score - F.length(name) * F.lit(0.1).cast("double")


def _lead(parts: Column, word: str) -> Column:
    return F.aggregate(F.transform(parts, lambda p, i: F.when(p.startswith(word), 100 - i * 10).otherwise(0)), F.lit(0), lambda a, x: a + x)


def highlight(text: Column, term: str) -> Column:
    """The term's first occurrence marked; where there is none, the first occurrence of each of its words, one after the other."""

    def first(x: Column, word: str) -> Column:
        at = F.locate(word, F.lower(x))
        marked = F.concat(F.substring(x, F.lit(1), at - 1), F.lit("<mark>"), F.substring(x, at, F.lit(len(word))), F.lit("</mark>"), F.substring(x, at + len(word), F.length(x)))
        return F.when(at > 0, marked).otherwise(x)

    if not term.strip():
        return text
    plain = term.lower()
    return F.when(F.lower(text).contains(plain), first(text, plain)).otherwise(reduce(first, plain.split(), text))


def node_size(degree: Column) -> Column:
    return F.greatest(F.lit(2.0), F.log2(degree + 1) * 4)


def node_class(degree: Column) -> Column:
    return F.when(degree >= 8, "hub").when(degree >= 3, "medium").when(degree <= 1, "leaf").otherwise("minor")


def ttl_seconds(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in TTL_DAYS.items() for x in (k, v * 86400)])
    return F.coalesce(F.try_element_at(table, status), F.lit(30 * 86400))


def math_key(context: Column, question: Column) -> Column:
    """Key of a stored calculation: the context's first 2,000 characters and the question without case."""
    return F.md5(F.concat_ws("::", F.substring(context, 1, 2000), F.lower(question)))


def constraint_key(question: Column, context: Column) -> Column:
    """Key of stored constraints: the question without case and the context's first 1,000 characters."""
    return F.md5(F.concat_ws("::", F.lower(question), F.substring(context, 1, 1000)))


def simulated_progress(elapsed_ms: Column) -> Column:
    """Percent shown while a document is processed: 90 after five minutes and no more, 10 at least in the first five seconds."""
    percent = elapsed_ms * 90 / 300_000
    return F.least(F.lit(90), F.floor(F.when(elapsed_ms < 5000, F.greatest(percent, F.lit(10.0))).otherwise(percent) + 0.5).cast("int"))


def size_kb(size: Column) -> Column:
    return F.round(size / 1024, 1)


def edge_class(label: Column) -> Column:
    return F.when(label.isin("CONTRADICTS", "SUPERSEDES", "NEGATES"), "adversarial").when(label == "REVISES", "revision").otherwise("plain")


def variable_lines(variables: Column) -> Column:
    """A map as lines of ``name = value``, in the map's order."""
    return F.array_join(F.transform(F.map_entries(variables), lambda e: F.concat(e["key"], F.lit(" = "), e["value"].cast("string"))), "\n")


def graph_tier(n_nodes: Column) -> Column:
    """How much of a graph of so many nodes is drawn."""
    return reduce(lambda rest, tier: F.when(n_nodes <= tier[1], tier[0]).otherwise(rest), reversed(TIERS), F.lit("large"))


def context_line(source: Column, section: Column, page: Column, score: Column, text: Column) -> Column:
    """A hit as the model reads it; what is missing is Unknown, General, ? and 0.50."""
    return F.format_string("[Source: %s | Section: %s | Pg %s | Score: %.2f]\n%s", F.coalesce(source, F.lit("Unknown")), F.coalesce(section, F.lit("General")), F.coalesce(page.cast("string"), F.lit("?")), F.coalesce(score, F.lit(0.5)).cast("double"), F.coalesce(text, F.lit("")))


def is_graph_context(text: Column) -> Column:
    return text.contains(GRAPH_MARK)


def valid_question(question: Column) -> Column:
    """The trimmed question, or null where it holds a NUL or hasn't 3 to 2,000 characters."""
    plain = F.trim(question)
    return F.when(F.length(question).between(3, 2000) & (F.instr(question, "\x00") == 0) & (F.length(plain) > 0), plain)


def is_retryable(kind: Column, status: Column) -> Column:
    """Network failures and timeouts, and answers 429 and from 500 on."""
    return kind.isin("connection", "timeout") | F.coalesce((status == 429) | (status >= 500), F.lit(False))


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def utc_now() -> Column:
    """Now, in UTC, as text that sorts by time."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def json_object(text: Column) -> Column:
    """The object between the first { and the last } as a map of texts, without code fences; empty if there is none."""
    plain = F.regexp_replace(text, "```(?:json)?", "")
    return F.coalesce(F.from_json(F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit("")), "map<string,string>"), F.create_map().cast("map<string,string>"))


def defined_terms(text: Column) -> Column:
    """Terms that a text defines in quotes, pattern by pattern."""
    return F.concat(*[F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)) for p in DEFINITIONS])


def alias_window(text: Column, header_chars: int = 8000, most_tokens: int = 4000, front: int = 3000, back: int = 1000) -> Column:
    """Where a document defines its terms: the part after a header of definitions, the paragraph around each definition, and the whole text or its two ends.

    Parts whose first 200 characters are equal count once. Null stays null.
    """
    header, patterns = re.compile(DEFINITION_HEADER, re.I), [re.compile(p, re.I) for p in DEFINITIONS]

    def of(x: str) -> str:
        parts = [x[m.start() : m.start() + header_chars] for m in [header.search(x)] if m]
        for hit in (m for p in patterns for m in p.finditer(x)):
            stop = x.find("\n\n", hit.end())
            parts.append(x[max(0, x.rfind("\n", 0, hit.start())) : stop if stop >= 0 else hit.end() + 500])
        words = x.split()
        parts.append(x if len(words) <= most_tokens else " ".join(words[:front]) + "\n\n[...]\n\n" + " ".join(words[-back:]))
        return "\n\n---\n\n".join({p[:200]: p for p in reversed(parts)}[k] for k in dict.fromkeys(p[:200] for p in parts))

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else of(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def quote_key_sections(markdown: Column) -> Column:
    """Sections under a heading of KEY_SECTIONS as quotes, line by line; a section ends before the next heading."""
    head = r"(?is)^(.*?)(#{1,3}\s*(?:" + "|".join(KEY_SECTIONS) + r").*)$"
    quoted = lambda x: F.concat(F.regexp_extract(x, head, 1), F.lit("> "), F.regexp_replace(F.regexp_extract(x, head, 2), "\n", "\n> "))
    return F.array_join(F.transform(F.split(markdown, r"(?=\n#{1,3})"), lambda x: F.when(x.rlike(head), quoted(x)).otherwise(x)), "")


def toggled(selected: Column, item: Column) -> Column:
    return F.when(F.array_contains(selected, item), F.array_remove(selected, item)).otherwise(F.array_append(selected, item))


def query_keywords(question: Column, named: Column, expansions: dict[str, list[str]] | None = None) -> Column:
    """At most 8 names found in a question, then expansions of its defined terms, each once and without honorifics; its longer words where no name was found."""
    table = expansions if expansions is not None else EXPANSIONS
    empty = F.array().cast("array<string>")
    words = F.filter(F.split(F.trim(question), r"\s+"), lambda w: w != "")
    more = empty
    if table:
        known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
        more = F.flatten(F.filter(F.transform(words, lambda w: F.try_element_at(known, F.regexp_replace(F.lower(w), "[^a-z]", ""))), lambda x: x.isNotNull()))
    first = F.slice(named, 1, 8)
    found = F.concat(first, F.array_except(more, first))
    return F.when(F.size(F.coalesce(named, empty)) > 0, F.transform(found, strip_honorific)).otherwise(F.filter(words, lambda w: F.length(w) > 4))


def phrase_score(name: Column, keyword: Column) -> Column:
    """Share of a name's words that a keyword found in it as a phrase makes up; 0 where it isn't."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
    n, k = plain(name), plain(keyword)
    held = (k != "") & F.contains(F.concat(F.lit(" "), n, F.lit(" ")), F.concat(F.lit(" "), k, F.lit(" ")))
    return F.when(held, F.size(F.split(k, " ")) / F.size(F.split(n, " "))).otherwise(0.0)


def edge_text(name: Column, aliases: Column, relation: Column, other: Column, relation2: Column, leaf: Column) -> Column:
    """An edge as the model reads it, with the first end's aliases, and the leaf below where there is one."""
    label = F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, F.concat(name, F.lit(" (aka: "), F.array_join(aliases, ", "), F.lit(")"))).otherwise(name)
    more = F.when(relation2.isNotNull() & leaf.isNotNull(), F.concat(F.lit("\n  └─> ["), relation2, F.lit("] --> ("), leaf, F.lit(")"))).otherwise("")
    return F.concat(F.lit("("), label, F.lit(") -["), relation, F.lit("]-> ("), other, F.lit(")"), more)
