"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions propose spans. The four base kinds keep every match that
passes its rule (parts, Luhn, number of digits) and drop every other one: a match
that fails is no span of any kind, nor is a piece of it. Looser patterns propose
local phone numbers and spelled-out addresses. Each proposed span is voted on by
labelers that say personal (1), not personal (0) or nothing (-1): the rule of
its kind, a second shape test, a gazetteer (top-level domains, country codes,
issuer digits, reserved address ranges), the words before it, and its
neighbour characters. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is and how likely each pattern is
personal; a logistic classifier over kind, votes and length is trained on those
probabilities and decides about the spans of the looser kinds.

Only counts by (kind, votes, length bucket) reach the driver: at most 6 x 3^5 x
3 rows, whatever the corpus. Spans are code points, end exclusive. Null and
empty texts have no spans; without any span, or in an empty table, nothing is
learned; very long texts are read whole. One row out per row in; repeated rows
give equal rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.common import id_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("local_phone", "spelled_email")

#: Patterns by kind. Possessive repeats and look-behinds match what the plain
#: forms match, without backtracking or recursion on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # with dots only in groups of 3, 3 and 4 digits: other dotted numbers are versions and dates
    "local_phone": r"(?<![0-9+.])(?:(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ -])[0-9]{3,4}[ -][0-9]{3,4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})"
                   r"(?![0-9])(?!\.[0-9])",
    "spelled_email": r"(?i)(?<![a-z0-9._-])[a-z0-9][a-z0-9._-]{0,63} ?[\[(]at[\])] ?"
                     r"[a-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[a-z0-9-]{1,63}){1,4}",
}
#: A text without this cannot match the pattern; the cheap test comes first.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
NEEDS_MATCH = {"card": "[0-9]", "local_phone": "[0-9]", "spelled_email": r"(?i)[\[(]at[\])]"}

#: Gazetteers.
TOP_LEVEL = ("com|org|net|edu|gov|mil|int|info|biz|io|de|fr|es|uk|it|nl|be|at|ch|pl|pt|se|no|fi|dk|ie|eu|us|ca|mx|"
             "br|ar|au|nz|jp|cn|in|ru|za")
COUNTRY_CODE = (r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[0-9]|37[0-9]|38[0-9]|"
                r"42[0-3]|85[2356]|88[06]|96[0-8]|97[0-7]|99[2-8])")
CUES = {
    "email": "mail|contact|write|reply|cc:|to:|from:",
    "ip": r"\bip\b|address|host|server|login|client|from",
    "card": "card|visa|master|amex|credit|debit|payment|account",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|contact|sms",
    "local_phone": "phone|tel|call|mobile|cell|fax|whatsapp|contact|sms",
    "spelled_email": "mail|contact|write|reply",
}
CONTEXT = 24
LABELERS = 5
EM_ROUNDS = 25
TRAIN_ROUNDS = 300

OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SPAN = "array<struct<kind:int,start:int,end:int,m:string>>"


def matches(text: Column, kind: str) -> Column:
    """All leftmost non-overlapping matches with their positions: the matches,
    and the text between them, give the offsets by their lengths."""
    pattern, number = PATTERNS[kind], KINDS.index(kind)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["1"])
        end = start + F.length(x["0"])
        return F.when(x["0"].isNull(), acc).otherwise(F.struct(
            end.alias("pos"), F.concat(acc["out"], F.array(F.struct(
                F.lit(number).alias("kind"), start.alias("start"), end.alias("end"), x["0"].alias("m")))).alias("out")))

    empty = F.array().cast(SPAN)
    found = F.aggregate(zipped, F.struct(F.lit(0).alias("pos"), empty.alias("out")), add, lambda acc: acc["out"])
    can = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(NEEDS_MATCH[kind])
    return F.when(can, found).otherwise(empty)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    rev = F.reverse(digits(m))

    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        d = F.when(acc["odd"], 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return F.struct((acc["sum"] + d).alias("sum"), (~acc["odd"]).alias("odd"))

    chars = F.filter(F.split(rev, ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add,
                       lambda acc: acc["sum"] % 10 == 0)


def by_kind(kind: Column, values: dict[str, Column], other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(kind == KINDS.index(name), value).otherwise(out)
    return out


def rule(kind: Column, m: Column) -> Column:
    """Whether a match passes the rule of its kind (looser kinds never do)."""
    n = F.length(digits(m))
    return by_kind(kind, {"email": F.lit(True), "ip": m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
                          "card": n.between(14, 19) & luhn(m), "phone": n.between(10, 15)}, F.lit(False))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def votes(text: Column, c: Column) -> Column:
    """One vote of each labeler about a span."""
    kind, m, never = c["kind"], c["m"], F.lit(False)
    base = kind < len(BASE_KINDS)
    shape = by_kind(kind, {
        "email": vote(m.rlike(r"\.[A-Za-z]{2,}$"), m.rlike(r"(?:^[.]|\.\.|\.@|[0-9]$)")),
        "ip": vote(~m.rlike(r"(?:^|\.)0[0-9]"), m.rlike(r"(?:^|\.)0[0-9]")),
        "card": vote(F.length(m).isin(16, 19) & m.rlike("^[0-9]{4}([ -]?)[0-9]{4}"), F.length(digits(m)) < 13),
        "phone": vote(m.rlike(r"^\+[0-9]{1,3}[ (.-]"), m.rlike(r"[.]{2}|\(\)")),
        "local_phone": vote(m.rlike(r"^\("), m.rlike(r"\.[0-9]+\.")),
    }, F.lit(-1))
    tld = F.lower(F.regexp_extract(m, r"([A-Za-z]+)[\])]?$", 1))
    listed = by_kind(kind, {
        "email": vote(tld.rlike(f"^(?:{TOP_LEVEL})$"), tld == ""),
        "spelled_email": vote(tld.rlike(f"^(?:{TOP_LEVEL})$"), tld == ""),
        "ip": vote(never, m.rlike(r"^0*(?:0|10|127|255)\.|^192\.168\.")),
        "card": vote(m.rlike("^[3-6]"), m.rlike("^[0178]")),
        "phone": vote(m.rlike(COUNTRY_CODE), m.rlike(r"^\+0")),
    }, F.lit(-1))
    size = F.least(c["start"], F.lit(CONTEXT))
    context = F.lower(text.substr(c["start"] - size + 1, size))
    said = by_kind(kind, {k: context.rlike(cue) for k, cue in CUES.items()}, never)
    around = F.concat(text.substr(c["start"], F.when(c["start"] > 0, 1).otherwise(0)), F.lit(" "),
                      text.substr(c["end"] + 1, F.lit(1)))
    inside = around.rlike(r"[\p{L}\p{N}_]")
    return F.array(F.when(base, rule(kind, m).cast("int")).otherwise(-1), shape, listed, vote(said, never),
                   vote(~inside, inside))


def candidates(text: Column) -> Column:
    """All proposed spans of a text: kind, start, end, base, votes, bucket."""
    found = F.concat(*[matches(text, k) for k in KINDS])
    return F.transform(found, lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), rule(c["kind"], c["m"]).alias("base"),
        votes(text, c).alias("votes"),
        F.when(F.length(c["m"]) < 12, 0).when(F.length(c["m"]) < 20, 1).otherwise(2).alias("bucket")))


def pattern_counts(spans: DataFrame) -> list:
    """Counts of (kind, votes, bucket) over a column ``candidates``: a bounded table."""
    return (spans.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.bucket")
            .agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes", "bucket").collect())


def reliabilities(rows: list) -> dict:
    """EM for labelers that vote independently given the truth. Returns the
    probability of being personal by (kind, votes)."""
    count: dict = {}
    for r in rows:
        key = (r.kind, tuple(r.votes))
        count[key] = count.get(key, 0) + r.n
    belief = {}
    for key in count:
        said = [v for v in key[1] if v >= 0]
        belief[key] = (1 + sum(said)) / (2 + len(said))
    for _ in range(EM_ROUNDS):
        prior: dict = {}
        table: dict = {}
        for (kind, vs), n in count.items():
            p = belief[kind, vs]
            for truth, share in ((1, p), (0, 1 - p)):
                prior[kind, truth] = prior.get((kind, truth), 1.0) + n * share
                for i, v in enumerate(vs):
                    table[i, truth, v] = table.get((i, truth, v), 0.0) + n * share
        total = {(i, t): sum(table.get((i, t, v), 0) for v in (-1, 0, 1)) for i in range(LABELERS) for t in (0, 1)}
        for kind, vs in count:
            log = {t: math.log(prior[kind, t]) + sum(
                math.log((table.get((i, t, v), 0.0) + (2 if v == t else 1)) / (total[i, t] + 4))
                for i, v in enumerate(vs)) for t in (0, 1)}
            belief[kind, vs] = 1 / (1 + math.exp(max(-50.0, min(50.0, log[0] - log[1]))))
    return belief


def features(kind: int, vs, bucket: int) -> list[str]:
    return [f"kind={kind}", f"bucket={bucket}"] + [f"{i}={v}" for i, v in enumerate(vs) if v >= 0]


def train(rows: list) -> dict[str, float]:
    """Weights of the logistic classifier, by feature, from EM's probabilities."""
    belief = reliabilities(rows)
    total = sum(r.n for r in rows) or 1
    data = [(features(r.kind, r.votes, r.bucket), belief[r.kind, tuple(r.votes)], r.n / total) for r in rows]
    weights: dict[str, float] = {}
    for _ in range(TRAIN_ROUNDS):
        grad: dict[str, float] = {}
        for fs, target, share in data:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(weights.get(f, 0.0) for f in fs)))))
            for f in fs:
                grad[f] = grad.get(f, 0.0) + share * (target - p)
        for f, g in grad.items():
            weights[f] = weights.get(f, 0.0) + 2.0 * g - 1e-4 * weights.get(f, 0.0)
    return weights


def probability(c: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability for a span."""
    def pick(values: list[float], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), at + 1)

    z = pick([weights.get(f"kind={k}", 0.0) for k in range(len(KINDS))], c["kind"])
    z = z + pick([weights.get(f"bucket={b}", 0.0) for b in range(3)], c["bucket"])
    for i in range(LABELERS):
        z = z + pick([0.0] + [weights.get(f"{i}={v}", 0.0) for v in (0, 1)], F.element_at(c["votes"], i + 1) + 1)
    return 1 / (1 + F.exp(-z))


def accepted(found: Column, weights: dict[str, float], threshold: float = 0.5) -> Column:
    """Base spans, and those of the looser kinds that the classifier takes, by
    start, then kind. A looser span gives way to a base span it overlaps, and to a
    failed match of a base kind that reaches beyond it."""
    base = F.filter(found, lambda c: c["base"])
    first = F.filter(found, lambda c: c["kind"] < len(BASE_KINDS))
    more = F.filter(found, lambda c: (c["kind"] >= len(BASE_KINDS)) & (probability(c, weights) >= threshold)
                    & ~F.exists(first, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
                                & (b["base"] | (b["start"] < c["start"]) | (b["end"] > c["end"]))))
    return F.array_sort(F.transform(F.concat(base, more), lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"))))


def listing(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that
    overlap, the first (then the longest) is named and all are removed."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def add(acc: Column, s: Column) -> Column:
        over = s["start"] < acc["pos"]
        gap = text.substr(acc["pos"] + 1, s["start"] - acc["pos"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"),
                        F.when(over, acc["out"]).otherwise(
                            F.concat(acc["out"], F.array(gap, F.element_at(names, s["kind"] + 1)))).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    by_start = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                            .otherwise(b["end"] - a["end"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(by_start, start, add, lambda acc: F.concat(
        F.array_join(acc["out"], ""), text.substr(acc["pos"] + 1, F.length(text) - acc["pos"]))))


def with_spans(docs: DataFrame, found: DataFrame | None = None, text_col: str = "text") -> tuple[DataFrame, dict]:
    """Learn from all of ``docs`` and return (docs with a column ``candidates``, weights)."""
    rows = docs.withColumn("candidates", candidates(F.coalesce(F.col(text_col), F.lit("")))) if found is None else found
    return rows, train(pattern_counts(rows))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=None) -> DataFrame:
    """doc_id and spans (start, kind, end, base) of every row. ``keep`` may
    write the table of proposed spans once and give it back."""
    rows = id_text(docs, id_col, text_col).select("doc_id", candidates(F.col("text")).alias("candidates"))
    rows = rows if keep is None else keep(rows)
    weights = train(pattern_counts(rows))
    return rows.select("doc_id", accepted(F.col("candidates"), weights).alias("spans"))
