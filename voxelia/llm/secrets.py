"""Secret scans through a trigram inverted index, with DataFrame functions only.

Every rule's regex is turned into a Boolean query over trigrams that each of its matches must hold. The
index maps a trigram to the documents that hold it; the postings of a query's trigrams are intersected
and joined by document, and the regex runs on those candidates only. A rule without a mandatory trigram
runs on every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind, regex (Java's and Python's common ground), and the least length of a group; shorter matches are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The base rules.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Rules beyond the base, public formats of well-known credentials.
MORE_RULES = (
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is a set of alternatives, each a set of trigrams that must all occur; EVERY holds for any text.
EVERY = frozenset([frozenset()])
MOST_STRINGS = 64


def absorb(query) -> frozenset:
    return frozenset(a for a in query if not any(b < a for b in query))


def both(p, q) -> frozenset:
    return absorb({a | b for a in p for b in q})


def of_strings(strings) -> frozenset:
    return absorb({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def trigram_query(regex: str) -> frozenset:
    """The Boolean trigram query of a regex, over text in lower case."""

    def walk(items) -> tuple[set[str] | None, frozenset]:
        """(all strings it can match, or None), and the query of what it must hold."""
        run, query, whole = {""}, EVERY, True

        def cut() -> None:
            nonlocal run, query, whole
            query, run, whole = both(query, of_strings(run)), {""}, False

        for kind, what in items:
            exact, inner = None, EVERY
            if kind is op.LITERAL:
                exact = {chr(what).lower()}
            elif kind is op.IN and all(k is op.LITERAL for k, _ in what):
                exact = {chr(x).lower() for _, x in what}
            elif kind is op.SUBPATTERN:
                exact, inner = walk(what[3])
            elif kind is op.BRANCH:
                ways = [walk(w) for w in what[1]]
                exact = set().union(*(w[0] for w in ways)) if all(w[0] is not None for w in ways) else None
                inner = absorb(frozenset().union(*(both(w[1], of_strings(w[0])) if w[0] is not None else w[1] for w in ways)))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                least, most, sub = what
                own, held = walk(sub)
                if own is not None and most == 1:
                    exact = own | ({""} if least == 0 else set())
                elif least > 0:
                    inner = both(held, of_strings(own)) if own is not None else held
            if exact is not None and len(exact) * len(run) <= MOST_STRINGS:
                run = {a + b for a in run for b in exact}
                continue
            cut()
            query = both(query, of_strings(exact) if exact is not None else inner)
        if whole:
            return run, EVERY
        return None, both(query, of_strings(run))

    exact, query = walk(_parser.parse(regex))
    return query if exact is None else of_strings(exact)


def build_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram int, id): which documents hold trigrams[trigram], letters in either case."""
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low")).where("low is not null")
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]), lambda x: x.isNotNull())
    return low.select("id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, trigrams: list[str], queries: dict[str, frozenset]) -> DataFrame:
    """(id, rules array<string>): documents whose postings satisfy a rule's query, with those rules."""
    place = {t: k for k, t in enumerate(trigrams)}
    words = range((len(trigrams) + 62) // 63)
    by_doc = index.groupBy("id").agg(*[
        F.bit_or(F.when((F.col("trigram") >= 63 * w) & (F.col("trigram") < 63 * w + 63), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") - 63 * w)).otherwise(F.lit(0).cast("long"))).alias(f"m{w}")
        for w in words
    ])

    def holds(query: frozenset) -> Column:
        def every(alternative) -> Column:
            need = [sum(1 << (place[t] - 63 * w) for t in alternative if place[t] // 63 == w) for w in words]
            return reduce(lambda a, b: a & b, [F.col(f"m{w}").bitwiseAND(F.lit(n)) == F.lit(n) for w, n in zip(words, need, strict=True)])

        return reduce(lambda a, b: a | b, [every(a) for a in sorted(query, key=sorted)])

    found = F.filter(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]), lambda x: x.isNotNull())
    return by_doc.select("id", found.alias("rules")).where(F.size("rules") > 0)


def spans(rule: Rule, matches: Column, keys: Column, rest: Column, number: int) -> Column:
    """Spans (start, number, kind, end) in code points, from all matches and the texts between them."""
    kind = "struct<at:bigint,out:array<struct<start:bigint,number:int,kind:string,end:bigint>>>"

    def step(acc, i):
        start = acc["at"] + F.char_length(F.get(rest, i))
        end = start + F.char_length(F.get(matches, i))
        span = F.struct(start.cast("long").alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end"))
        fine = F.char_length(F.get(keys, i)) >= rule.least
        return F.struct(end.cast("long").alias("at"), F.when(fine, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,number:int,kind:string,end:bigint>>").alias("out")).cast(kind)
    return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, lambda a, i: step(a, i).cast(kind))["out"]


def fast(rule: Rule) -> tuple[str, int]:
    """A regex of the same spans for a rule that is one class repeated, with its least length inside; else as it is."""
    if rule.group == 0 and rule.least and rule.regex.endswith("]+") and rule.regex.startswith("[") and rule.regex.count("[") == 1:
        return f"{rule.regex[:-1]}{{{rule.least},}}", 0
    return rule.regex, rule.group


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<start, number, kind, end>>): one row per input row, spans by start, then rule.

    Spans count code points, end exclusive; matches of one rule are leftmost and don't overlap. Null and
    empty texts have no spans. Rows that share an id, or have none, are all scanned; other columns are
    dropped. An empty table gives an empty table.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != EVERY}
    trigrams = sorted({t for q in indexed.values() for a in q for t in a})
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = candidates(build_index(docs, trigrams, id_col, text_col), trigrams, indexed) if trigrams else None
    if found is not None:
        found = found.select(F.col("id").alias("cid"), "rules")
        rows = rows.join(found, F.col("id").eqNullSafe(F.col("cid")), "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    rows = rows.select("id", "text", *[
        F.when((F.array_contains("rules", r.kind) if r.kind in indexed else F.lit(True)), F.regexp_extract_all("text", F.lit(fast(r)[0]), 0)).alias(f"m{k}")
        for k, r in enumerate(rules)
    ])
    some = [F.size(f"m{k}") > 0 for k in range(len(rules))]
    rows = rows.select(
        "id", *[f"m{k}" for k in range(len(rules))],
        *[F.when(some[k], F.split("text", fast(r)[0], -1)).otherwise(empty).alias(f"r{k}") for k, r in enumerate(rules)],
        *[F.when(some[k], F.regexp_extract_all("text", F.lit(r.regex), r.group)).otherwise(empty).alias(f"k{k}") for k, r in enumerate(rules) if fast(r)[1]],
    )
    none = F.array().cast("array<struct<start:bigint,number:int,kind:string,end:bigint>>")
    each = [F.when(some[k], spans(r, F.col(f"m{k}"), F.col(f"k{k}" if fast(r)[1] else f"m{k}"), F.col(f"r{k}"), k)).otherwise(none) for k, r in enumerate(rules)]
    return rows.select(F.col("id").alias(id_col), F.sort_array(F.concat(*each)).alias("spans"))


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and the joined spans."""
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["number"] < len(BASE_RULES))
    return scanned.select(id_col, *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
