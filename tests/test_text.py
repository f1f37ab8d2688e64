"""HTML -> text and the small string functions, against a plain-Python model
of the rules and against the edge cases listed in FIXTURES.md section 1.7."""

import random

from pyspark.sql import functions as F

from corpusmap.functions import text as TX

BREAKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table"}
ENT = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
       ("&amp;", "&")]


def model(s: str) -> str:
    """Scanner written from the rules: tags to the first '>', block tags break,
    entities once, whitespace runs collapse, leading run dropped, trailing
    spaces/newlines dropped."""
    out = []
    pending = None  # None: nothing to separate yet; ' ' or '\n' pending separator
    started = False
    i, n = 0, len(s)
    while i < n:
        c = s[i]
        if c == "<":
            j = s.find(">", i)
            if j < 0:
                break
            body = s[i + 1:j]
            name = body[1:] if body.startswith("/") else body
            brk = False
            for t in BREAKS:
                if name[:len(t)].lower() == t and (len(name) == len(t) or name[len(t)] in " \t\n\r/"):
                    brk = True
            if brk and started:
                pending = "\n"
            i = j + 1
            continue
        if c == "&":
            hit = next(((e, t) for e, t in ENT if s.startswith(e, i)), None)
            if hit:
                if pending:
                    out.append(pending)
                    pending = None
                out.append(hit[1])
                started = True
                i += len(hit[0])
                continue
        if c in " \t\n\r":
            if started and pending is None:
                pending = " "
            i += 1
            continue
        if pending:
            out.append(pending)
            pending = None
        out.append(c)
        started = True
        i += 1
    return "".join(out).rstrip(" \n")


EDGE = ["", "<", "a<b", "<<p>x", "a <p> b", "a&nbsp;<p>b", "&amp;lt;", "&am<b>p;", "<pre>x</pre>", "<BR/>x",
        "x &copy; y", "<!-- a > b -->", " &nbsp;x", "<p>&nbsp;</p>", "a&nbsp; <p>b", "a\n\n<div class='x'>\nb</div>  ",
        "<li>one</li><li>two</li>", "x<p/>y", "x<P\t>y", "x<table>y", "x<tbody>y", "x<h7>y"]


def _random_strings(k: int, seed: int = 7):
    rnd = random.Random(seed)
    atoms = ["<", ">", "<p>", "</p>", "<br/>", "<div a='1'>", "<b>", "&amp;", "&lt;", "&nbsp;", "&#39;", "&x;",
             " ", "\n", "\t", "a", "b", "é", "<<p>", "</li >", "<H3>", "&", "amp;", "<pre>"]
    return ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 14))) for _ in range(k)]


def test_model_matches_edges_reference_examples():
    assert model("a <p> b") == "a\nb"
    assert model("a&nbsp;<p>b") == "a \nb"
    assert model("&amp;lt;") == "&lt;"
    assert model("&am<b>p;") == "&amp;"
    assert model("<<p>x") == "x"


def test_html_to_text_matches_model(spark):
    cases = EDGE + _random_strings(3000)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, s string")
    got = {r["i"]: r["t"] for r in df.select("i", TX.html_to_text("s").alias("t")).collect()}
    bad = [(cases[i], got[i], model(cases[i])) for i in range(len(cases)) if got[i] != model(cases[i])]
    assert not bad, bad[:5]


def test_html_to_text_sql_matches_spark(spark):
    import duckdb
    cases = EDGE + _random_strings(500, seed=11)
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INT, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(cases)))
    duck = dict(con.execute(f"SELECT i, {TX.html_to_text_sql('s')} FROM t").fetchall())
    for i, s in enumerate(cases):
        assert duck[i] == model(s), (s, duck[i])


def test_between_number_atoi(spark):
    df = spark.createDataFrame([("x<a>1,024</a>y<a>7</a>",), ("<a>no close",), ("none",), (None,)], "s string")
    r = df.select(TX.text_between("s", "<a>", "</a>").alias("b"),
                  TX.parse_number(TX.text_between("s", "<a>", "</a>")).alias("n")).collect()
    assert [(x.b, x.n) for x in r] == [("1,024", 1024), (None, 0), (None, 0), (None, 0)]
    a = spark.createDataFrame([(" 42x",), ("-7",), ("x1",), ("",), ("\t+3",)], "s string") \
        .select(TX.atoi("s").alias("v")).collect()
    assert [x.v for x in a] == [42, -7, 0, 0, 3]


def test_truncate_bytes_drops_cut_code_point(spark):
    df = spark.createDataFrame([("ab" + "é" * 3,), ("abc",)], "s string")
    r = df.select(TX.truncate_bytes("s", 5).alias("t")).collect()
    assert r[0].t == "abé"      # 'a','b' + 2-byte é = 4 bytes; the next é would cut
    assert r[1].t == "abc"
    r = df.select(TX.truncate_bytes("s", 3).alias("t")).collect()
    assert r[0].t == "ab"


def test_split_lines_and_query_form(spark):
    df = spark.createDataFrame([("a\n\nb\n",)], "s string")
    assert df.select(TX.split_lines("s").alias("x")).first().x == ["a", "b"]
    df = spark.createDataFrame([("Hack The North",)], "s string")
    assert df.select(TX.query_form("s").alias("x")).first().x == "hack+the+north"


def test_raw_bodies_of_one_row_group_are_written_by_all_tasks(spark):
    from corpusmap.sources.store import read_raw_bodies, write_raw_bodies
    from corpusmap.streaming.ingest import scratch_root
    root = scratch_root(spark, "test-raw")
    rows = spark.range(24).selectExpr("id", "concat(id, '\n', repeat('body ', 40000 + id), '\n\n') AS text")
    rows.coalesce(1).write.parquet(f"{root}/in")
    write_raw_bodies(spark.read.parquet(f"{root}/in"), f"{root}/bodies", "id", "text")
    bodies = read_raw_bodies(spark, f"{root}/bodies", "id")
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in bodies.inputFiles()}) > 1
    assert len(bodies.inputFiles()) == 24                         # one file a body
    assert {r.id: r.body for r in bodies.collect()} == {r.id: r.text for r in rows.collect()}
