from pyspark.sql import functions as F

from sitelode.functions import scalars
from sitelode.operators import content

PAGE = """<!DOCTYPE html><HTML lang="fr"><head><TITLE> A &amp; B </TITLE><style>p{}</style>
<script>var t="<p>no</p>";</script></head><body><!-- <p>gone</p> --><p>Bon<b>jour</b></p>
<a class="x" href="/abs?q=1">1</a><a href="rel.html">2</a><a href="http://other.onion/x">3</a><a href="//cdn.org/y">4</a>
<a href="#top">5</a><a href="mailto:a@b">6</a><A HREF="JavaScript:go()">7</A><a href="">8</a></body></html>"""


def pages(spark, url="https://Site.ONION/dir/page?x=/y", html=PAGE):
    return spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")


def test_hosts(spark):
    urls = {
        "http://Abc.Onion": "abc.onion", "https://user:pw@h.org:8080/x@y": "h.org", "ftp://h.org?x=//z": "h.org",
        "http://h.org/a b|c": "h.org", "http://[::1]:80/": "[::1]", "h.org/x": None, "/rel": None, "http:///x": None, "": None,
    }
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in frame.select(content.host_of("url")).collect()] == list(urls.values())


def test_page_extract(spark):
    row = content.page_extract(pages(spark)).first()
    assert (row.host, row.title, row.language) == ("site.onion", "A & B", "fr")
    assert row.visible_text == "Bon jour 1 2 3 4 5 6 7 8"
    plain = content.page_extract(pages(spark, "not a url at all", "just text")).first()
    assert (plain.host, plain.title, plain.language, plain.visible_text) == (None, None, None, "just text")


def test_link_extract_makes_links_absolute(spark):
    links = [r.link for r in content.link_extract(pages(spark)).orderBy("position").collect()]
    assert links == [
        "https://Site.ONION/abs?q=1", "https://Site.ONION/dir/rel.html", "http://other.onion/x", "https://cdn.org/y",
    ]
    bare = content.link_extract(pages(spark, "http://h.org", '<a href="x">')).first()
    assert bare.link == "http://h.org/x"


def test_page_fields_in_all_quote_forms(spark):
    for lang in ('"de"', "'de'", "de"):
        page = f"<html class=x lang={lang}><meta content='An &quot;x&quot; &amp;lt;' name=description><meta name='keywords' content='k'>a&nbsp;&copy;"
        row = content.page_extract(pages(spark, html=page)).first()
        assert (row.language, row.description, row.visible_text) == ("de", 'An "x" &lt;', "a \u00a9")


def links(spark, html, url="http://h.org/dir/page?x=1#f"):
    return [r.link for r in content.link_extract(pages(spark, url, html)).orderBy("position").collect()]


def test_links_of_every_form(spark):
    for href, link in {
        "'/one'": "http://h.org/one", "/two": "http://h.org/two", '"?q=1"': "http://h.org/dir/page?q=1", "../up": "http://h.org/up",
        '"./a/../b/."': "http://h.org/dir/b/", '"/a/../../x?y=/../z"': "http://h.org/x?y=/../z", '"x?a=1&amp;b=2"': "http://h.org/dir/x?a=1&b=2",
        '" y "': "http://h.org/dir/y", "HTTPS://o.org/../z": "HTTPS://o.org/z", "//c.org/..": "http://c.org/",
    }.items():
        assert links(spark, f"<A id=1 HREF = {href}>t</A>") == [link], href
    for href in ("tel:12", "'data:x'", '"ftp://x/y"', "'#'", "''", "MAILTO:x"):
        assert links(spark, f"<a href={href}>t</a>") == [], href
    assert links(spark, "<!-- <a href='/gone'> --><script>'<a href=/no>'</script><a data-href='/no2' href='/yes'>") == ["http://h.org/yes"]
    assert links(spark, "<base href='/root/'><a href=x>") == ["http://h.org/root/x"]
    assert links(spark, "<base target=_blank href='http://b.org/k/l'><a href=x><a href='/y'>") == ["http://b.org/k/x", "http://b.org/y"]


def test_null_seeds_reach_nothing(spark):
    assert reach(spark, [(1, 2)], [1, None], 1) == {1: 0, 2: 1}


def reach(spark, edges, seeds, depth):
    frame = spark.createDataFrame(edges, "src int, dst int")
    nodes = spark.createDataFrame([(s,) for s in seeds], "node int")
    rows = content.link_bfs(frame, nodes, depth).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.depth for r in rows}


def test_bfs_depths_cycles_and_nesting(spark):
    edges = [(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (4, 5), (5, 6), (9, 1), (1, 2), (2, None)]
    assert reach(spark, edges, [1, 1], 0) == {1: 0}
    assert reach(spark, edges, [1], 2) == {1: 0, 2: 1, 3: 1, 4: 2}
    assert reach(spark, edges, [1, 5], 1) == {1: 0, 5: 0, 2: 1, 3: 1, 6: 1}
    whole = reach(spark, edges, [1], 50)
    assert whole == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: 4}
    for depth in range(4):
        shallow, deeper = reach(spark, edges, [1], depth), reach(spark, edges, [1], depth + 1)
        assert shallow.items() <= deeper.items()


def test_page_cap(spark):
    frame = spark.range(200).select(
        F.concat(F.lit("h"), (F.col("id") % 2).cast("string")).alias("host"), F.lit(0).alias("depth"), F.col("id").cast("string").alias("url")
    )
    capped = content.page_cap(frame)
    assert {r.host: r.n for r in capped.groupBy("host").agg(F.count("*").alias("n")).collect()} == {"h0": 50, "h1": 50}
    assert content.page_cap(frame, cap=1).filter("host = 'h1'").first().url == "1"
    wanted = {tuple(r) for r in capped.collect()}
    threshold = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(threshold, "10")  # a cap above the threshold takes the salted way
    try:
        salted = content.page_cap(frame)
        assert {tuple(r) for r in salted.collect()} == wanted and salted.columns == capped.columns
    finally:
        spark.conf.unset(threshold)


def test_language(spark):
    rows = [
        ("The cat sat on the mat and it was happy",), ("Der Hund und die Katze sind nicht auf dem Dach",),
        ("le chat est dans la maison et les enfants",), ("el perro y la casa de los vecinos",), ("xyz",), (None,),
    ]
    got = [r.detected for r in content.lang_detect(spark.createDataFrame(rows, "text string")).collect()]
    assert got == ["en", "de", "fr", "es", None, None]


def test_language_agrees_with_labels(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = content.lang_detect(documents).filter("detected IS NOT NULL")
    assert found.agg(F.avg((F.col("lang") == F.col("detected")).cast("int"))).first()[0] > 0.9


def test_scalars(spark):
    frame = spark.createDataFrame([(0.2499,), (0.25,), (0.5,), (0.75,), (None,)], "s double")
    assert [r[0] for r in frame.select(scalars.risk_bucket("s")).collect()] == ["low", "medium", "high", "critical", None]
    row = spark.createDataFrame([(["a"], ["f", "g"], True, 0.5)], "c array<string>, r array<string>, h boolean, p double")
    score = scalars.risk_score(F.col("c"), F.col("r"), F.col("h"), F.col("p"))
    assert abs(row.select(score).first()[0] - 1.0) < 1e-9
    none = spark.createDataFrame([(None, None, None, None)], row.schema)
    assert none.select(score).first()[0] == 0.2
    names = spark.createDataFrame([("unknown",), ("dead",), (None,)], "s string")
    assert [r[0] for r in names.select(scalars.status_normalize("s")).collect()] == ["discovered", "dead", None]
    tags = spark.createDataFrame([(["a", "b"],), (["a"],), ([],)], "t array<string>")
    picked = tags.select(scalars.has_any_tag("t", ["a", "z"]), scalars.has_all_tags("t", ["a", "b", "a"])).collect()
    assert [tuple(r) for r in picked] == [(True, True), (True, False), (False, False)]
    title = spark.createDataFrame([("x",), (None,)], "t string").select(scalars.title_hash("t").alias("h")).collect()
    assert len(title[0].h) == 64 and title[1].h is None
    text = spark.createDataFrame([('{"k": 5}',), ("not json",), (None,)], "j string")
    assert [r[0] for r in text.select(scalars.json_feature("j", "$.k")).collect()] == ["5", None, None]
