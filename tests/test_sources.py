from html.parser import HTMLParser

from fabula.functions import markup
from fabula.sources import files
from fabula.streaming import live


def test_read_works(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("été".encode())
    (tmp_path / "b.txt").write_bytes("été".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.xyz").write_bytes(b"?")
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.text) for r in files.read_works(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("ok", "été"), "b.txt": ("ok", "été"), "c.pdf": ("needs_decoder", None), "d.xyz": ("unsupported", None)}


def test_json_works(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "w", "text": "t",\n "author": "a"}')
    assert [tuple(r) for r in files.read_json_works(spark, str(tmp_path)).collect()] == [("w", "w", "a", None, "t")]


class Blocks(HTMLParser):
    """A second implementation, on a parser of the standard library."""

    def __init__(self, markup):
        super().__init__(convert_charrefs=True)
        self.skip, self.parts, self.text = 0, [], []
        self.feed(markup)
        self.close()
        self.end()

    def end(self):
        self.parts += [x for x in ["".join(self.text).strip()] if x]
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in markup.RAW + markup.FURNITURE
        if not self.skip and tag in markup.BLOCKS:
            self.end()
        elif tag == "br":
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in markup.RAW + markup.FURNITURE:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in markup.BLOCKS:
            self.end()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def test_block_text(spark):
    odd = ["<p>a<br>b</p><script>x</script><div>c &amp; d</div>e<nav>n</nav>", "plain", "<p>open", '<p title="a > b">x</p>', "<P>A</P><!-- <p>no</p> -->b", "a < b <i>c</i>d", "<header>x<nav>y</nav>z</header><li>1<li>2", "<div>a<nav>never closed <p>b", "<script>var t='</p>';</script><p>&#233;&#x1F642;&eacute;&amp;lt;</p>", "<pre> two\n lines </pre><h1></h1>", "", None, "<style>p{}</style><blockquote>q</blockquote>" * 300, "<p>" + "word " * 200_000 + "</p>"]
    df = spark.createDataFrame(list(enumerate(odd)), "id long, html string")
    got = {r.id: r.text for r in files.html_text(df, "id").collect()}
    assert got == {k: "\n\n".join(Blocks(x or "").parts) for k, x in enumerate(odd)}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    assert {r.page_id: r.text for r in files.html_text(pages, "page_id").collect()} == {k: "\n\n".join(Blocks(x).parts) for k, x in html.items()}


STORED = {"nodes": "work_id long, pos int, node_id string", "edges": "work_id long, edge_id string"}


def _store_files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_graph_store(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, "n001"), (2, 0, "n001")], "work_id long, pos int, node_id string")
    edges = spark.createDataFrame([(1, "e001")], "work_id long, edge_id string")
    files.save_graphs(nodes, edges, str(tmp_path))
    n, e = files.load_graphs(spark, str(tmp_path), 1, stored=STORED)
    assert [r.work_id for r in n.collect()] == [1] and e.count() == 1
    assert files.load_graphs(spark, str(tmp_path), stored=STORED)[0].count() == 2


def test_deletes_rewrite_their_buckets_only(spark, tmp_path):
    store = tmp_path / "store"
    nodes = spark.createDataFrame([(w, p, f"n{p}") for w in range(200) for p in range(3)], "work_id long, pos int, node_id string")
    edges = spark.createDataFrame([(w, "e0") for w in range(0, 200, 2)], "work_id long, edge_id string")
    files.save_graphs(nodes, edges, str(store))
    before, gone = _store_files(store), spark.createDataFrame([(3,), (4,), (3,), (10_000,), (None,)], "work_id long")
    files.delete_graphs(spark, str(store), gone, str(tmp_path / "s1"), stored=STORED)
    want = [(w, 3, 1 - w % 2) for w in range(200) if w not in (3, 4)]
    assert sorted(map(tuple, files.list_graphs(spark, str(store), STORED).collect())) == want
    after = _store_files(store)
    touched = {p.split("bucket=")[1].split("/")[0] for p in before.keys() - after.keys()}
    assert 1 <= len(touched) <= 4 and all(after[p] == t for p, t in before.items() if p.split("bucket=")[1].split("/")[0] not in touched)
    # Again: the same store; then all of it.
    files.delete_graphs(spark, str(store), gone, str(tmp_path / "s2"), stored=STORED)
    assert sorted(map(tuple, files.list_graphs(spark, str(store), STORED).collect())) == want
    files.delete_graphs(spark, str(store), nodes.select("work_id"), str(tmp_path / "s3"), stored=STORED)
    assert files.list_graphs(spark, str(store), STORED).count() == 0 and not _store_files(store)


def test_empty_stores(spark, tmp_path):
    path = str(tmp_path / "none")
    assert files.list_graphs(spark, path).count() == 0
    files.delete_graphs(spark, path, spark.createDataFrame([(1,)], "work_id long"), str(tmp_path / "s0"))
    files.save_graphs(*(spark.createDataFrame([], s) for s in STORED.values()), path)
    assert files.list_graphs(spark, path).count() == 0 and files.load_graphs(spark, path, 5)[0].count() == 0


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "line string")
    files.export(df, str(tmp_path / "t"), "line")
    files.export(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2 and spark.read.json(str(tmp_path / "j")).columns == ["line"]


def test_stream_deduplicates(spark, tmp_path):
    rows = spark.createDataFrame([(1, "comparison", "Critique", 0.9, None), (1, "comparison", "Critique", 0.9, None), (2, "analysis", None, None, 7)], "id long, kind string, level string, score double, n_nodes int").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = live.run_available(live.live_notifications(stream).select("id", "notice", "value"), str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == [(1, "ip", 90), (2, "analysis", 7)]


def test_a_batch_that_runs_again_leaves_its_rows_once(spark, tmp_path):
    path, rows = str(tmp_path / "sink"), spark.createDataFrame([(1,), (2,)], "id long")
    assert live.read_batches(spark, path, rows.schema).count() == 0
    step = live.batch_writer(path)
    for n in (0, 1, 1, 0):
        step(rows.withColumn("id", rows.id + 10 * n), n)
    assert sorted(r.id for r in live.read_batches(spark, path, rows.schema).collect()) == [1, 2, 11, 12]


def test_a_stream_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    out = live.per_batch(stream, str(tmp_path / "out"), lambda batch: batch.selectExpr("id", "length(text) AS n"))
    assert out.count() == 0 and out.columns == ["id", "n"]


def test_live_quota_across_a_restart(spark, tmp_path):
    """Rows out of order within the watermark, in two runs of one stream with a stop between them."""
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(4), datetime(2024, 1, 1)
    made = [(k, rng.randint(0, 3), rng.choice(["analyze_llm", "comparison", "login"]), start + timedelta(minutes=k * 37 + rng.randint(-20, 20), microseconds=rng.randint(0, 999))) for k in range(1500)]
    made += [(5000, 1, "comparison", made[700][3]), (5001, 1, "comparison", made[700][3]), (5002, None, "comparison", made[700][3])]
    made.sort(key=lambda r: r[3] + timedelta(minutes=rng.randint(0, 15)))
    got = None
    for part, rows in enumerate((made[:800], made[800:])):
        spark.createDataFrame(rows, "id long, user_id long, action string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, user_id long, action string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = live.run_available(live.live_quota(stream), str(tmp_path / "out"))
        assert part or got.count() > 300
    bills = [r for r in made if r[2] != "login" and r[1] is not None]
    mark = max(r[3] for r in made if r[2] != "login") - timedelta(hours=1)
    want = []
    for i, user, _, t in bills:
        if t <= mark.replace(microsecond=mark.microsecond // 1000 * 1000):
            mine = [r[3] for r in bills if r[1] == user and r[3] <= t]
            day = [x for x in mine if x >= t - timedelta(hours=24)]
            want.append((user, i, len(day), sum(x >= t - timedelta(days=30) for x in mine), int((min(day) + timedelta(hours=24) - t) / timedelta(hours=1))))
    assert sorted(map(tuple, got.collect())) == sorted(want)
