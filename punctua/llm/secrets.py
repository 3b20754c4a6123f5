"""Operator 4, secret scans: a trigram inverted index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as re_kind
from re import _parser as re_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctua.llm.common import counted, looked_up



@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern in the common subset of Java and Python, and the least length of a group (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in their order, then kinds that the method adds.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
#: Documents of one index block, the most ids of a posting list.
BLOCK_ROWS = 2048
#: Small character classes are spelled out up to so many readings of a run of literals.
MOST_ALTERNATIVES = 8

# A query is a trigram, ("and", queries), ("or", queries), or None, which every text meets.


def all_of(queries: list) -> object:
    queries = list(dict.fromkeys(q for q in queries if q is not None))
    return None if not queries else queries[0] if len(queries) == 1 else ("and", tuple(queries))


def any_of(queries: list) -> object:
    queries = list(dict.fromkeys(queries))
    return None if None in queries or not queries else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def trigrams(literal: str) -> list[str]:
    return [literal[i : i + 3] for i in range(len(literal) - 2)]


def derived(items) -> object:
    """The Boolean trigram query of a parsed pattern: what each text that it matches must hold, in lower case."""
    found, runs = [], [""]  # runs: what the last literals may read
    for op, value in items:
        if op is re_kind.LITERAL:
            runs = [r + chr(value).lower() for r in runs]
            continue
        if op is re_kind.IN and len(value) <= MOST_ALTERNATIVES and all(kind is re_kind.LITERAL for kind, _ in value):
            runs = list(dict.fromkeys(r + chr(c).lower() for r in runs for _, c in value))
            if len(runs) <= MOST_ALTERNATIVES:
                continue
        found.append(any_of([all_of(trigrams(r)) for r in runs]))
        runs = [""]
        if op is re_kind.SUBPATTERN:
            found.append(derived(value[3]))
        elif op is re_kind.BRANCH:
            found.append(any_of([derived(x) for x in value[1]]))
        elif op in (re_kind.MAX_REPEAT, re_kind.MIN_REPEAT) and value[0] > 0:
            found.append(derived(value[2]))
    return all_of([*found, any_of([all_of(trigrams(r)) for r in runs])])


def query_of(rule: Rule) -> object:
    return derived(re_parser.parse(rule.pattern))


def named(query: object) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(named, query[1]))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id") -> DataFrame:
    """key, rules: the rules whose trigram query each document meets.

    The index holds the trigrams that the queries name. Its postings are lists of keys within blocks (keys by their digest, so a
    list is bounded and no block is hot); a query intersects and unites the lists of a block.
    """
    queries = {r.kind: q for r in rules if (q := query_of(r)) is not None}
    grams = sorted(set().union(*map(named, queries.values())))
    hits = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    lowered = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("low"))
    # an outer explode, as a filter on the hits would be pushed below the lower-casing and repeat it for each trigram
    held = lowered.select("key", F.explode_outer(hits).alias("gram")).where("gram IS NOT NULL")
    # the number of blocks follows the number of documents
    block = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-docs.count() // BLOCK_ROWS))))
    postings = held.select("key", block.alias("block"), "gram").groupBy("block", "gram").agg(F.collect_set("key").alias("keys"))
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))
    none = F.array().cast(docs.select(F.array(key).alias("a")).schema["a"].dataType)

    def met(query: object) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.try_element_at("lists", F.lit(grams.index(query))), none)
        return reduce(F.array_intersect if query[0] == "and" else F.array_union, map(met, query[1]))

    def of_kind(kind: str):
        return lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind"))

    found = [F.transform(met(q), of_kind(kind)) for kind, q in queries.items()]
    return lists.select(F.explode(F.concat(*found)).alias("c")).groupBy("c.key").agg(F.collect_set("c.kind").alias("rules")).select("key", "rules")


def sums_before(values: Column) -> Column:
    """For each element of an array of longs the sum of those before it, by sums of chunks of about the root of the length."""
    size = F.size(values)
    chunk = F.greatest(F.lit(1), F.ceil(F.sqrt(size.cast("double"))).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    state = F.struct(values.alias("v"), chunk.alias("c"))

    def with_chunks(s: Column) -> Column:
        sums = F.transform(upto(F.ceil(F.size(s["v"]) / s["c"]).cast("int")), lambda j: total(F.slice(s["v"], j * s["c"] + 1, s["c"])))
        return F.struct(s["v"].alias("v"), s["c"].alias("c"), sums.alias("s"))

    def with_tops(s: Column) -> Column:
        tops = F.transform(upto(F.size(s["s"])), lambda j: total(F.slice(s["s"], F.lit(1), j)))
        return F.struct(s["v"].alias("v"), s["c"].alias("c"), tops.alias("t"))

    def result(s: Column) -> Column:
        at = lambda i: F.get(s["t"], F.floor(i / s["c"]).cast("int")) + total(F.slice(s["v"], F.floor(i / s["c"]).cast("int") * s["c"] + 1, i % s["c"]))
        return F.transform(upto(F.size(s["v"])), at)

    one = F.transform(F.transform(F.transform(F.array(state), with_chunks), with_tops), result)
    return F.element_at(one, 1)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches, leftmost and not overlapping, in code points. Splitting by the pattern gives what lies between the matches."""
    every = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    lengths = F.transform(every, lambda x: F.length(x).cast("long"))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(lengths)), lengths, lambda gap, length: gap + length)
    tested = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x)) if rule.group else lengths
    both = F.arrays_zip(between.alias("gap"), lengths.alias("len"), sums_before(steps).alias("before"), tested.alias("tested"))
    good = F.filter(F.slice(both, F.lit(1), F.size(lengths)), lambda m: m["tested"] >= rule.least)
    return F.transform(good, lambda m: F.struct((m["before"] + m["gap"]).alias("start"), (m["before"] + m["gap"] + m["len"]).alias("end")))


def find_secrets(docs: DataFrame, key: str = "doc_id", rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """docs with a column `name`: array<struct<start, order, end, kind>> by start, then the rules' order. Columns of docs stay, but for one of that name.

    Candidates of a rule come from the index and are verified on the text with its pattern; rules without a mandatory trigram (hex)
    scan every text. Null texts have no secret. Candidates are looked up by key; rows that share a key are each verified on their
    own text, so repeated keys give right results too. Texts are shuffled for rows that may be candidates only, and only beyond the
    bound of a broadcast. The index holds no null key: rows without a key are candidates of every rule.
    """
    slim = docs.select(key, "text")
    found, n = counted(candidates(slim, rules, key).select(F.col("key").alias("__key"), F.col("rules").alias("__rules")), "candidates")
    rows = looked_up(docs, F.xxhash64(F.col(key)), found, F.xxhash64("__key"), n, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    text, parts = F.coalesce(F.col("text"), F.lit("")), []
    nothing = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")

    def placed(i: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"))

    for i, rule in enumerate(rules):
        scan_all = query_of(rule) is None
        matched = F.rlike(text, F.lit(rule.pattern))
        wanted = matched if scan_all else F.when(F.col(key).isNull(), matched).otherwise(F.coalesce(F.array_contains("__rules", rule.kind), F.lit(False)))
        parts.append(F.when(wanted, F.transform(spans_of(text, rule), placed(i, rule.kind))).otherwise(nothing))
    return rows.withColumn(name, F.array_sort(F.concat(*parts))).drop("__rules")


def said(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. Null text is empty."""
    rows = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["order"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by `[kind]`, and n_chars counted anew there; columns and rows stay, other texts are untouched.

    Overlapping spans count as one, under the first kind. Null texts stay null.
    """
    rows = find_secrets(docs, name="__secrets")
    changed = rows.withColumn("text", redacted(F.col("text"), F.col("__secrets")))
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.size("__secrets") > 0, count).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def redacted(text: Column, secrets: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        kept = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        fresh = F.concat(s["out"], kept, F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.when(x["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    finish = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(secrets) == 0, text).otherwise(F.aggregate(secrets, start, step, finish))
