"""Base spans against Python's regular expressions; redaction; EM."""

import random
import re
from collections import Counter, namedtuple

from pyspark.sql import functions as F

from corpusmap.llm import pii


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def number(m):
    return re.sub("[^0-9]", "", m)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(number(m)) <= 19 and luhn(number(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(number(m)) <= 15),
]


def base(text):
    out = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def rows_with_data():
    rnd = random.Random(5)
    parts = ["+1 (017) 555-7713", "a.b@c.d.e", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "call ",
             "555 123 4567", "joe [at] x [dot] com", ".", "@", " ", "x", "+49 30 1234567 ", "00.01.2.255", ".5", "é", "mail me: "]
    letters = "a1.@+- ()b9éZ_%\n"
    rows = [(1000 + i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for i in range(400)]
    return rows + [(2000 + i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120)))) for i in range(400)]


def test_base_spans(make_docs, edge_rows):
    rows = edge_rows + rows_with_data()
    found = pii.find_personal_data(make_docs(rows))
    only = F.filter("spans", lambda s: s["base"])
    got = found.select("doc_id", pii.listing(only).alias("base"), pii.listing(F.col("spans")).alias("all")).collect()
    assert Counter((r.doc_id, r.base) for r in got) == Counter((i, base(t)) for i, t in rows)
    assert all(set(r.base.split(",")) - {""} <= set(r.all.split(",")) for r in got)


def test_long_runs_do_not_overflow(make_docs):
    text = "a@b" + ".c" * 30_000 + " " + "1" * 50_000 + " " + "a" * 50_000 + "@ " + "1.2.3.4 " * 300
    (r,) = pii.find_personal_data(make_docs([(1, text)])).collect()
    assert len(r.spans) == 301 and r.spans[0].end == 3 + 60_000


def test_empty_table(no_docs):
    assert pii.find_personal_data(no_docs).count() == 0


def test_redaction(spark):
    texts = ["write to joe@x.com, or +1 (017) 555-7713!", "nothing", None, "é 1.2.3.4"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found, weights = pii.with_spans(df)
    got = [r.t for r in found.select(pii.redact(F.col("text"), pii.accepted(F.col("candidates"), weights)).alias("t")).collect()]
    assert got == ["write to [EMAIL], or [PHONE]!", "nothing", None, "é [IP]"]


def test_em_tells_reliable_labelers():
    Row = namedtuple("Row", "kind votes bucket n")
    rows = [Row(0, [1, 1, 1, -1, 1], 0, 900), Row(0, [0, 0, 0, -1, 1], 0, 800), Row(0, [1, 1, 0, -1, 1], 0, 50),
            Row(0, [0, 0, 1, -1, 1], 0, 50)]
    belief = pii.reliabilities(rows)
    assert belief[0, (1, 1, 1, -1, 1)] > 0.95 and belief[0, (0, 0, 0, -1, 1)] < 0.05
    assert belief[0, (1, 1, 0, -1, 1)] > 0.5 > belief[0, (0, 0, 1, -1, 1)]
    weights = pii.train(rows)
    assert weights["0=1"] > 0 > weights["0=0"] and pii.train([]) == {}


def test_plan_has_no_python(make_docs, edge_rows):
    df = make_docs(edge_rows).select(pii.candidates(F.col("text")).alias("c")).select(pii.accepted(F.col("c"), {}).alias("s"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_spelled_email_in_any_case(spark):
    texts = ["JOHN [AT] EXAMPLE [DOT] COM", "Joe (At) x (Dot) org", "joe [at] x [dot] com", "AT EXAMPLE DOT COM"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.m for r in df.select(pii.matches(F.col("text"), "spelled_email").alias("m")).collect()]
    assert [[s.m for s in m] for m in got] == [texts[:1], texts[1:2], texts[2:3], []]


def test_failed_matches_stay_out(make_docs):
    """Numbers that fail a base rule, versions, dates and ids are no spans, with and without cue words; loose kinds come in."""
    bad = ["1.2.3.400", "999.10.10.1", "+1 23 45", "4111 1111 1111 1112", "12.345.6789", "version 3.141.5926", "2024-01-17",
           "17.01.2024", "1.22.333.4444", "order 4111-1111-1111-1112-99"]
    good = [("call (017) 555-7713 today", "local_phone"), ("phone: 555 123 4567", "local_phone"), ("tel 555.123.4567", "local_phone"),
            ("write joe [at] example [dot] com", "spelled_email"), ("mail a.b@c.org", "email"), ("card 4111 1111 1111 1111", "card")]
    rows = [(i, t) for i, t in enumerate(bad)] + [(100 + i, f"please call {t} or mail") for i, t in enumerate(bad)]
    rows += [(200 + i, t) for i, (t, _) in enumerate(good)] * 5
    got = {r.doc_id: r.spans for r in pii.find_personal_data(make_docs(rows)).collect()}
    assert all(not got[i] for i in range(len(bad))) and all(not got[100 + i] for i in range(len(bad)))
    for i, (t, kind) in enumerate(good):
        assert [pii.KINDS[s.kind] for s in got[200 + i]] == [kind], t


def test_query_counts_base_spans_by_kind(spark, tmp_path):
    """the counts are of the kinds, wherever a span stands in its text."""
    import hashlib
    from corpusmap.llm.queries import QUERIES
    rows = [(1, "a@b.c d@e.f 1.2.3.4"), (2, "1.2.3.4 a@b.c"), (3, "4111 1111 1111 1111, +49 30 1234567"), (4, None), (4, "none"),
            (5, "+49 30 1234567 x a@b.c 1.2.3.4 4111 1111 1111 1111")]
    df = spark.createDataFrame(rows + [(1000 + i, t) for i, t in rows_with_data()], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
                  for r in QUERIES["op3_personal_data"](spark, str(tmp_path)).collect())

    def expected(i, text):
        kinds = [s.split(":")[0] for s in base(text).split(",") if s]
        return (i, *[kinds.count(k) for k, _, _ in RULES], hashlib.sha256(base(text).encode()).hexdigest())

    assert got == Counter(expected(r.doc_id, r.text) for r in df.collect())
