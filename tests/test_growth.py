"""Work grows with the input, not with the square of a group of equal rows; results are those of the plain way."""

from __future__ import annotations

import io
import itertools
import tarfile

from pyspark.sql import functions as F

from lakeledger import queries
from lakeledger.operators import fuzzy, lexicon, matching
from lakeledger.options import Options
from lakeledger.sources import archive

from .conftest import SF_DIR


def joined_rows(spark, df) -> tuple[list, int]:
    """The rows of ``df``, and the most rows that one of its joins makes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.collect()
        todo, most = [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            found = node.metrics().get("numOutputRows")
            if "Join" in node.nodeName() and found.isDefined():
                most = max(most, found.get().value())
            todo += [node.children().apply(k) for k in range(node.children().size())]
        return rows, most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_name_of_many_products_is_found_without_pairs(spark):
    parents = (None, "R1", "R2", "R3")
    right = [(f"R{k}", parents[k % 4] if k % 9 else None, "Acme", f"Red  {k % 3}") for k in range(300)]
    left = [(k, ("R1", "R3", "none", None)[k % 4], "acme", f"red {k % 4}") for k in range(200)]
    expected = {}
    for (i, parent, _, name), (r, p, _, other) in itertools.product(left, right):
        if name == other.lower().replace("  ", " "):
            expected[i] = min(expected.get(i, (True, True, "~")), (p != parent, p is not None, r))
    there = spark.createDataFrame(right, "id string, parent_id string, vendor string, name string")
    wanted = spark.createDataFrame(left, "id long, expected_parent string, vendor string, name string")
    rows, most = joined_rows(spark, matching.find_by_name(wanted, there))
    assert {r.left_id: r.right_id for r in rows} == {i: r for i, (_, _, r) in expected.items()} and len(rows) == 150
    assert most <= len(left)


def test_each_archive_is_indexed_by_its_own_task(spark, tmp_path):
    members = spark.range(400, numPartitions=1).select(F.format_string("data/brands/%d.yaml", "id").alias("name"), F.format_string("slug: s%d\n", "id").alias("body"))
    archive.write_archives(members, f"{tmp_path}/a", per_file=20)
    archive.write_index(spark, f"{tmp_path}/a", f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert index.agg(F.sum("n")).first()[0] == 400
    # a file is written by one task, and holds its archives
    most = index.groupBy(F.input_file_name()).agg(F.count_distinct("path").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert tuple(most) == (1, 20)


def test_only_nulls_are_told_from_other_scalars():
    text = "a: null\nb: ~\nc:\nd: 'null'\ne: yes\nf: 12\ng: 2024-01-02\nh: [~, no, NULL, 0x1F, .inf]\ni: {j: Null, k: '~'}\nl: &x {m: 1.0}\nn: {<<: *x, o: =}\n"
    assert archive.yaml_documents(text) == [{"d": "null", "e": "yes", "f": "12", "g": "2024-01-02", "h": "no,0x1F,.inf", "i.k": "~", "l.m": "1.0", "n.m": "1.0", "n.o": "="}]


def test_pairs_are_dealt_to_many_tasks(spark):
    left, right = queries.decomposed(spark, SF_DIR)
    one = left.select("brand").orderBy("brand").first().brand
    found = fuzzy.paired(left.filter(F.lower("brand") == one), right).groupBy(F.spark_partition_id().alias("p")).count()
    assert found.count() > 4


def test_each_spelling_is_scanned_once(spark):
    """Copies of a name are told apart by their id alone, and the lexicon counts each of them."""
    names = [("Acme", "dual color red"), ("Zed", "dual color blue"), (None, "silk red")]
    rows = [(k, *names[k % 3], "PLA Silk" if k % 2 else None, None) for k in range(60)]
    products = spark.createDataFrame(rows, "id long, vendor string, name string, material string, hex string")
    scans = spark.sparkContext.accumulator(0)
    whole = fuzzy.name_parts

    def counted(name, vendor, material, tags, index):
        parts = whole(name, vendor, material, tags, index)
        seen = F.udf(lambda n: (scans.add(1), n)[1], "string").asNondeterministic()
        return F.when(seen(name).isNotNull(), parts)

    fuzzy.name_parts = counted
    try:
        got = fuzzy.decomposed(products, "id", "vendor", "name", "material", "hex", Options()).collect()
    finally:
        fuzzy.name_parts = whole
    assert len(got) == 60 and {(r.id % 6, r.brand, r.family) for r in got} == {(k, ("acme", "zed", "")[k % 3], "pla" if k % 2 else "") for k in range(6)}
    assert scans.value == 6
    counts = {r.term: r.freq for r in lexicon.mine(products, "name", "vendor", "material").collect()}
    assert counts["dual color"] == 40 and counts["red"] == 40


def test_best_scores_are_those_of_the_matches(spark):
    left, right = queries.decomposed(spark, SF_DIR)
    top = fuzzy.matches(left, right, Options()).filter("rank = 1").select("left_id", "score")
    assert sorted(map(tuple, fuzzy.best_scores(left, right).collect())) == sorted(map(tuple, top.collect()))


ALIKE = "---\nslug: pack-{0}-{1}  # {1}\nmaterial: {{slug: part-{1}}}\ncontainer: &c\n  slug: 's-{0}'\nagain: *c\nnote: >\n  {1} {0}\n  {0}\nsizes: [{1}, ~, {0}.5]\nempty: ~\n---\n{0}\n---\nnet: {1}\n"


def test_texts_alike_but_for_digits_are_read_once(monkeypatch):
    texts = [ALIKE.format(k * 37, f"{k:03}") for k in range(400)]
    expected = [archive.flat(archive.yaml_documents(t)) for t in texts]
    read = []
    compose_all = archive.yaml.compose_all
    monkeypatch.setattr(archive.yaml, "compose_all", lambda *a, **k: read.append(a) or compose_all(*a, **k))
    archive.shape.cache_clear()
    archive.seen.cache_clear()
    assert [archive.flat_documents(t.encode()) for t in texts] == expected
    assert len(read) == 2  # for the first text and for the shape
    wanted = ("material.slug", "net", "none")
    assert archive.flat_documents(texts[7].encode(), wanted) == ([0, 2], [], [], ("part-007", None, None, None, "007", None))


def test_digits_that_are_more_than_text_in_a_value():
    pairs = [
        ("a: |2\n   x\n", "a: |3\n   x\n"), ("a: &x1 b\nc: &x2 d\ne: *x1\n", "a: &x1 b\nc: &x2 d\ne: *x2\n"), ('a: "\\x41"\n', 'a: "\\x42"\n'), ("5: a\n6: b\n", "5: a\n5: b\n"),
        ("a: {k1: ~, <<: {k1: b, k2: c}}\n", "a: {k2: ~, <<: {k1: b, k2: c}}\n"), ("%YAML 1.1\n---\na: b\n", "%YAML 9.1\n---\na: b\n"), ("a: !<tag:yaml.org,2002:null> b\n", "a: !<tag:yaml.org,2003:null> b\n"),
        ("1: ~\n", f"{'1' * 1100}: ~\n"), ("a: 1\n", "a: 100%\n"), ("a: 1\nb: ][\n", "a: 2\nb: ][\n"), ("a: '1%s'\n", "a: '2%s'\n"), ("a: 1\0\n", "a: 2\0\n"), ("", "0"),
    ]
    for pair in pairs:
        for text in (*pair, *reversed(pair)):
            assert archive.flat_documents(text.encode()) == archive.flat(archive.yaml_documents(text)), text
    assert archive.flat_documents(b"a: \xff1\n")[3] == ["\ufffd1"]


def test_members_as_tarfile_reads_them(tmp_path):
    for form, damage in itertools.product((tarfile.PAX_FORMAT, tarfile.GNU_FORMAT), ("", "header", "cut", "tail")):
        whole = io.BytesIO()
        with tarfile.open(fileobj=whole, mode="w", format=form) as tar:
            for k, name in enumerate(["data/brands/a.yaml", "b" * 100, "c" * 101, "é", "data/brands", *"defgh"]):
                info = tarfile.TarInfo(name)
                info.type = tarfile.DIRTYPE if name == "data/brands" else tarfile.REGTYPE
                info.size = 0 if info.isdir() else (0, 1, 512, 70_000)[k % 4]
                tar.addfile(info, io.BytesIO(bytes([k]) * info.size))
        data = bytearray(whole.getvalue())
        if damage == "header":
            data[data.rindex(b"f" + bytes(99)) + 150] ^= 1
        elif damage == "cut":
            del data[-12_000:]
        elif damage == "tail":
            data = data.rstrip(b"\0")
        path = tmp_path / f"{form}{damage}.tar"
        path.write_bytes(bytes(data))
        found, expected = [], []
        try:
            with tarfile.open(path, "r|") as tar:
                expected += ((m.offset, m.name, m.size, tar.extractfile(m).read() if m.isfile() else None) for m in tar)
        except tarfile.ReadError:
            expected.append(None)
        try:
            found += ((*m, read and read()) for *m, read in archive.members(archive.opened(str(path), 0)))
        except tarfile.ReadError:
            found.append(None)
        assert found == expected and len(found) > 5
    for name, size in itertools.product(("", "a/b.yaml", "x" * 100, "x" * 101, "é"), (0, 1, 8**11 - 1, 8**11)):
        info = tarfile.TarInfo(name)
        info.size = size
        assert archive.header(name, size) == info.tobuf()


def test_only_parts_of_wanted_kinds_are_opened(spark, tmp_path):
    name = F.when(F.col("id") < 300, F.format_string("data/brands/%d.yaml", "id")).otherwise(F.format_string("data/material-packages/p/%d.yaml", "id"))
    rows = spark.range(600, numPartitions=1).select(name.alias("name"), F.format_string("slug: s%d\nmaterial: {slug: m%d}\n", "id", F.col("id") % 7).alias("body"))
    archive.write_archives(rows, f"{tmp_path}/a", per_file=100, packed=30)
    archive.write_index(spark, f"{tmp_path}/a", f"{tmp_path}/index", part_bytes=1500)
    index = spark.read.parquet(f"{tmp_path}/index")
    assert index.select("path").distinct().count() == 7 and index.agg(F.sum("n")).first()[0] == 600  # three gzip members of 30 to a file
    every = archive.indexed(spark, f"{tmp_path}/index")
    some = archive.indexed(spark, f"{tmp_path}/index", ("package",), archive.PACKAGE_FIELDS)
    opened = [df.rdd.getNumPartitions() for df in (every, some)]
    assert opened[1] < opened[0] * 0.7
    as_map = archive.packages(every).orderBy("ord").collect()
    assert as_map == archive.packages(some).orderBy("ord").collect() and len(as_map) == 300
    totals = fuzzy.package_totals(archive.packages(some), archive.containers(every)).select("material", "n_packages").collect()
    assert {tuple(r) for r in totals} == {(f"m{k}", sum(i % 7 == k for i in range(300, 600))) for k in range(7)}
    assert archive.indexed(spark, f"{tmp_path}/index", ("container",)).count() == 0
