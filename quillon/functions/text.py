"""Text functions: intent, routing, redaction, extraction heuristics, capture classification, rendering. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Keyword lists, patterns and tables on which results depend.
RECALL = ["remember", "recall", "told me", "said that", "mentioned", "last time", "previously", "earlier", "before", "history", "past ", "talked about", "discussed", "you said", "i said", "we discussed"]
ACTION = ["how do i", "how to", "steps to", "run ", "execute", "deploy", "install", "build ", "create ", "fix ", "solve", "implement", "configure", "setup", "set up", "start ", "stop ", "restart", "update ", "upgrade", "debug", "troubleshoot"]
QUESTION = ["what ", "what's", "who ", "who's", "where ", "where's", "when ", "when's", "why ", "which ", "is it", "are there", "does ", "do ", "can ", "could ", "should ", "would ", "will ", "?"]
CODE = ["code", "function", "class", "import", "def ", "fn ", "struct ", "implement", "syntax", "compile", "runtime", "error in", "stack trace", "exception", "variable", "method", "API", "endpoint", "schema", "migration", "query", "SQL"]
VISUAL = ["image", "picture", "photo", "screenshot", "diagram", "chart", "graph", "visual", "looks like", "shown in", "display", "UI", "interface", "design", "layout"]
INTENTS = [("recall", RECALL), ("code", CODE), ("visual", VISUAL), ("action", ACTION), ("question", QUESTION)]
AFFINITY = [
    ("question", "episodic", 0.8), ("question", "semantic", 0.6), ("question", "procedural", 0.2),
    ("action", "procedural", 0.9), ("action", "semantic", 0.3), ("action", "episodic", 0.1),
    ("recall", "semantic", 0.8), ("recall", "episodic", 0.6), ("recall", "procedural", 0.3),
    ("code", "procedural", 0.8), ("code", "semantic", 0.6), ("code", "episodic", 0.3),
    ("visual", "episodic", 0.8), ("visual", "procedural", 0.2),
]
DEFAULT_AFFINITY = 0.5
COUNTING = ["how many", "how often", "how much", "list every", "list all", "count", "total number", "in total", "altogether", "over the course", "across sessions", "across all", "across the", "so far", "sum of", "aggregate"]
REDACTIONS = [
    (r"sk-[a-zA-Z0-9]{20,}|pk_(?:live|test)_[a-zA-Z0-9]{20,}|psy_[a-zA-Z0-9]{10,}|ghp_[a-zA-Z0-9]{36,}|Bearer\s+[a-zA-Z0-9._\-]{20,}", "[TOKEN_REDACTED]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
    (r"\b(?:\d[ -]?){13,16}\d\b", "[CC_REDACTED]"),
    (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[EMAIL_REDACTED]"),
    (r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\d)", "[PHONE_REDACTED]"),
    (r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[IP_REDACTED]"),
]
INJECTIONS = [r"ignore\s+(all\s+)?previous", r"disregard\s+(all\s+)?(above|previous)", r"system\s*:", r"<\|im_start\|>", r"\[INST\]", r"(?:^|\n)(?:---+|===+|###)\s*(?:instruction|system|prompt)"]
EMAIL, DATE, URL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"\d{4}-\d{2}-\d{2}", r"https?://[^\s<>\"]+"
PATTERNS = [("email", EMAIL), ("date", DATE), ("url", URL)]
FACT_VERBS = ["is", "prefers", "uses", "likes", "works at", "works on"]
SPLIT_VERBS = ["prefers", "likes", "uses", "knows", "is", "has", "wants", "needs"]
SUCCESS, FAILURE = ["fixed", "resolved", "solved", "completed", "done"], ["failed", "error", "broken", "crash", "bug"]
SECRETS = r"(?:psy_|sk-|ghp_|ghu_|AKIA|xox[bpas]-|eyJ)[A-Za-z0-9_\-]+"
DISCARD = [r"\b(?:fix(?:ed)? (?:typo|whitespace|spacing|indent))\b", r"\b(?:format(?:ted|ting)?|prettier|black|ruff format)\b", r"\b(?:lint(?:ed|ing)?|eslint|ruff check)\b", r"\b(?:import sort|isort|organize imports)\b", r"\b(?:boilerplate|scaffold|template)\b"]
TIER1 = [
    (r"\b(?:let'?s use|we (?:decided|chose|agreed|should use|will use))\b", "architecture-decision", 0.95),
    (r"\b(?:don'?t|do not|stop|never|no,? (?:don'?t|not))\b.*\b(?:mock|use|do|add|create)\b", "behavioral-preference", 0.9),
    (r"\b(?:we can'?t|cannot|must not)\b.*\b(?:use|because|since|due to)\b", "project-constraint", 0.9),
    (r"\b(?:switching|migrating|moving) (?:to|from)\b", "architecture-decision", 0.9),
]
TIER2 = [
    (r"\b(?:root cause|caused by|the (?:issue|problem|bug) (?:was|is))\b", "root-cause", 0.8),
    (r"\b(?:tried|attempted|approach .* (?:failed|didn'?t work))\b", "failed-approach", 0.8),
    (r"\b(?:performance|latency|throughput|speed|memory usage).*\b(?:\d+\s*(?:ms|s|MB|GB|%|x))\b", "performance-finding", 0.8),
    (r"\b(?:workaround|hack|work[- ]?around)\b", "non-obvious-solution", 0.8),
    (r"\b(?:depends on|dependency|requires|blocks|blocked by)\b", "dependency-finding", 0.75),
]
LONG_STATEMENT = (50, 0.7)
MAX_FACT, MAX_INLINE = 512, 100
KEYWORD_ENTITIES = [
    ("postgres", "database"), ("sqlite", "database"), ("mysql", "database"), ("migration", "database"), ("schema", "database"), ("drizzle", "database"),
    ("auth", "auth"), ("jwt", "auth"), ("oauth", "auth"), ("login", "auth"), ("api", "api"), ("endpoint", "api"), ("route", "api"), ("handler", "api"),
    ("deploy", "infrastructure"), ("docker", "infrastructure"), ("terraform", "infrastructure"), ("tofu", "infrastructure"),
    ("test", "testing"), ("pytest", "testing"), ("jest", "testing"), ("cache", "cache"), ("redis", "cache"),
]
TRIVIAL_DIRS = ["src", "lib", "app", "packages", "internal", "cmd"]
ABBREVIATIONS = [
    "dr.", "mr.", "mrs.", "ms.", "prof.", "sr.", "jr.", "inc.", "ltd.", "corp.", "co.", "vs.", "etc.", "approx.", "dept.", "est.", "e.g.", "i.e.", "no.", "vol.", "rev.",
    "u.s.", "u.k.", "u.n.", "jan.", "feb.", "mar.", "apr.", "jun.", "jul.", "aug.", "sep.", "oct.", "nov.", "dec.",
]


def any_of(text: Column, words: list[str]) -> Column:
    """Plain containment of any word."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def intent(query: Column) -> Column:
    """The first kind, in priority, of which a keyword is in the lower-cased query. Upper-case keywords so never match."""
    low, out = F.lower(query), None
    for name, words in INTENTS:
        out = F.when(any_of(low, words), name) if out is None else out.when(any_of(low, words), name)
    return out.otherwise("general")


def affinity(kind: Column, memory_type: Column) -> Column:
    out = None
    for i, t, score in AFFINITY:
        test = (kind == i) & (memory_type == t)
        out = F.when(test, score) if out is None else out.when(test, score)
    return out.otherwise(DEFAULT_AFFINITY)


def whole_phrase(text: Column, phrases: list[str]) -> Column:
    """Any phrase with no ASCII letter or digit next to it, in lower-cased text."""
    return F.lower(text).rlike("(^|[^0-9A-Za-z])(" + "|".join(phrases) + ")($|[^0-9A-Za-z])")


def route(query: Column) -> Column:
    return F.when(whole_phrase(query, COUNTING), "inject").otherwise("skip")


def redact(text: Column) -> Column:
    """Tokens, social security numbers, cards, e-mail, phones, addresses, in this order."""
    for pattern, label in REDACTIONS:
        text = F.regexp_replace(text, pattern, label)
    return text


def injection(text: Column) -> Column:
    out = F.lit(False)
    for p in INJECTIONS:
        out = out | text.rlike("(?im)" + p)
    return out


def split_first_space(fact: Column) -> tuple[Column, Column]:
    """(predicate, object): cut at the first space; without one, ("knows", fact)."""
    at = F.instr(fact, " ")
    return F.when(at > 0, F.substring_index(fact, " ", 1)).otherwise("knows"), F.when(at > 0, F.substr(fact, at + 1)).otherwise(fact)


def split_verb(fact: Column) -> tuple[Column, Column]:
    """(verb, rest): the first verb by list order with text on both sides; otherwise ("states", fact)."""
    low, verb, rest = F.lower(fact), None, None
    for v in SPLIT_VERBS:
        at = F.instr(low, v)
        before, after = F.trim(F.substr(fact, F.lit(1), at - 1)), F.trim(F.substr(fact, at + len(v)))
        test = (at > 0) & (F.length(before) > 0) & (F.length(after) > 0)
        verb = F.when(test, v) if verb is None else verb.when(test, v)
        rest = F.when(test, after) if rest is None else rest.when(test, after)
    return verb.otherwise("states"), rest.otherwise(fact)


def sentences(text: Column) -> Column:
    """Non-empty trimmed parts after dots and at newlines."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\.", ".\n"), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def heuristic_fact(sentence: Column) -> tuple[Column, Column, Column]:
    """(subject, predicate, object) of the first verb that is in the sentence as a word; null without one."""
    low, subject, verb, rest = F.lower(sentence), None, None, None
    for v in FACT_VERBS:
        at = F.instr(low, f" {v} ")
        left, right = F.substr(low, F.lit(1), at - 1), F.substr(low, at + len(v) + 2)
        # the last clause before the verb
        who = F.trim(F.element_at(F.split(F.regexp_replace(F.trim(left), ",+$", ""), ","), -1))
        what = F.regexp_replace(F.trim(right), r"\.+$", "")
        subject = F.when(at > 0, who) if subject is None else subject.when(at > 0, who)
        verb = F.when(at > 0, v) if verb is None else verb.when(at > 0, v)
        rest = F.when(at > 0, what) if rest is None else rest.when(at > 0, what)
    return subject, verb, rest


def outcome(content: Column) -> Column:
    low = F.lower(content)
    return F.when(any_of(low, SUCCESS), "success").when(any_of(low, FAILURE), "failure")


def capture(content: Column, kind: Column) -> tuple[Column, Column, Column]:
    """(tier, class, confidence) of a signal, null if it is discarded or nothing: discards, tier 1, tier 2, long statements."""
    drop = F.lit(False)
    for p in DISCARD:
        drop = drop | content.rlike("(?i)" + p)
    tier = F.when(drop, F.lit(None).cast("int"))
    label, conf = F.when(drop, F.lit(None).cast("string")), F.when(drop, F.lit(None).cast("double"))
    for n, patterns in ((1, TIER1), (2, TIER2)):
        for p, name, c in patterns:
            test = content.rlike("(?i)" + p)
            tier, label, conf = tier.when(test, n), label.when(test, name), conf.when(test, c)
    long = (kind == "user_statement") & (F.length(content) > LONG_STATEMENT[0])
    return tier.when(long, 2), label.when(long, "statement"), conf.when(long, LONG_STATEMENT[1])


def sanitise(content: Column) -> Column:
    """Secrets, long inline code, length."""
    text = F.regexp_replace(content, SECRETS, "[REDACTED]")
    return F.substring(F.regexp_replace(text, "`[^`]{" + str(MAX_INLINE + 1) + ",}`", "`[code omitted]`"), 1, MAX_FACT)


def slug(name: Column) -> Column:
    out = F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", "-")
    out = F.regexp_replace(F.regexp_replace(out, r"[_.\s]+", "-"), "[^a-zA-Z0-9-]", "")
    return F.regexp_replace(F.lower(out), "^-+|-+$", "")


def entity_name(path: Column, content: Column) -> Column:
    """The first directory of the path that says something, else a keyword's entity, else "project"."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & ~F.lower(p).isin(TRIVIAL_DIRS) & ~F.contains(p, F.lit(".")))
    out = F.when(F.size(parts) > 0, slug(F.get(parts, F.lit(0))))
    low = F.lower(content)
    for word, name in KEYWORD_ENTITIES:
        out = out.when(low.rlike(rf"\b{word}\b"), name)
    return out.otherwise("project")


def word_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the smaller set's size; 0 if either is empty."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def render(memory_type: Column, predicate: Column, obj: Column, trigger: Column, action: Column, content: Column) -> Column:
    return F.when(memory_type == "semantic", F.concat_ws(" ", predicate, obj)).when(memory_type == "procedural", F.concat(trigger, F.lit(" -> "), action)).otherwise(content)


def observation_text(action: Column, instance: Column, quantity: Column, unit: Column) -> Column:
    q = F.regexp_replace(quantity.cast("string"), r"\.0$", "")
    base = F.concat(action, F.lit(" "), instance)
    inner = F.when(quantity.isNotNull() & unit.isNotNull(), F.concat(q, F.lit(" "), unit)).when(quantity.isNotNull(), q).when(unit.isNotNull(), unit)
    return F.when(inner.isNotNull(), F.concat(base, F.lit(" ("), inner, F.lit(")"))).otherwise(base)


def keyed_fact(raw: Column) -> tuple[Column, Column]:
    """(key, json) of "[key] {json}"; otherwise the first 32 characters and the text as data."""
    key, payload = F.regexp_extract(raw, r"^\[(.*?)\] ", 1), F.regexp_extract(raw, r"(?s)^\[.*?\] (.*)$", 1)
    ok = raw.rlike(r"^\[.*?\] ") & F.get_json_object(payload, "$").isNotNull() & payload.rlike(r"^\s*\{")
    return F.when(ok, key).otherwise(F.substring(raw, 1, 32)), F.when(ok, payload).otherwise(F.to_json(F.struct(raw.alias("data"))))


def split_sentences(text: Column) -> Column:
    """Parts after . ! ? and white space before a capital or a quote; a part after an abbreviation joins it."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z\"])"), lambda s: F.trim(s)), lambda s: s != "")
    ends = "(?i)(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")$"
    empty = F.array().cast("array<string>")

    def join(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), part)))
        return F.when(F.coalesce(last.rlike(ends), F.lit(False)), joined).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, empty, join)


def unfence(text: Column) -> Column:
    """Text inside the first code fence, if there is one."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*(?:```[^`]*)?$", 1)
    return F.when(F.contains(text, F.lit("```")), inner).otherwise(F.trim(text))


OBSERVATIONS = "array<struct<entity_type:string,instance:string,action:string,quantity:double,unit:string,confidence:double>>"


def parse_observations(text: Column) -> Column:
    """The JSON array between the outermost brackets, all or nothing; confidence 0.8 by default, between 0 and 1."""
    parsed = F.from_json(F.regexp_extract(unfence(text), r"(?s)(\[.*\])", 1), OBSERVATIONS)
    whole = F.when(parsed.isNotNull() & F.forall(parsed, lambda o: o["instance"].isNotNull() & o["action"].isNotNull() & o["entity_type"].isNotNull()), parsed).otherwise(F.array().cast(OBSERVATIONS))
    return F.transform(whole, lambda o: F.struct(o["entity_type"].alias("entity_type"), o["instance"].alias("instance"), o["action"].alias("action"), o["quantity"].alias("quantity"), o["unit"].alias("unit"), F.least(F.greatest(F.coalesce(o["confidence"], F.lit(0.8)), F.lit(0.0)), F.lit(1.0)).alias("confidence")))


def found(text: Column, pattern: str) -> Column:
    """array<struct<match, first>>: what the pattern matches, in order, with the place of its first character (from 0)."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<match:string,first:int>>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        at = F.call_function("locate", m, text, s["at"])
        return F.struct((at + F.length(m)).alias("at"), F.concat(s["out"], F.array(F.struct(m.alias("match"), (at - 1).alias("first")))).alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), start, step)["out"]


def patterns(rows, key: str, text: str):
    """key, kind, n (from 1), match, first of all e-mail addresses, dates and addresses of pages in rows' texts."""
    all_ = F.array(*[F.struct(F.lit(k).alias("kind"), found(F.col(text), p).alias("found")) for k, p in PATTERNS])
    by_kind = rows.where(F.col(text).isNotNull()).select(key, F.explode(all_).alias("x"))
    return by_kind.select(key, "x.kind", F.posexplode("x.found").alias("i", "m")).select(key, "kind", (F.col("i") + 1).alias("n"), "m.match", "m.first")
