"""Text formats with their oddities, tabular readers, labels, playlists, audio listing."""

import json

import pytest
from pyspark.sql import functions as F

from resona.functions import ids, symbols
from resona.plans import catalogue as build
from resona.plans import evaluate
from resona.sources import feature_text as T
from resona.sources import tabular
from resona.streaming import ingest

ANY = dict.fromkeys(("rp", "rh", "bh"), T.ANY_WIDTH)


def write(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_rhythm_lines(spark, tmp_path):
    path = write(
        tmp_path,
        "out0.rh",
        "b'Rock/Queen - One.mp3',b'1.5',b'2.25',b'-3e-2'",
        'music/a b.mp3,1,2,3',
        '"x, y.mp3",4,5,6',
        "bad.mp3,1,zwei,3",
        "",
    )
    parsed = T.parse(T.read_lines(spark, path), "rh", 3)
    assert rows(T.good(parsed), "id", "rh") == [
        ("RockQueen-One", [1.5, 2.25, -0.03]),
        ("musicab", [1.0, 2.0, 3.0]),
        ("xy", [4.0, 5.0, 6.0]),
    ]
    aside = T.quarantined(parsed).collect()
    assert [(r["line"], r["reason"]) for r in aside] == [("bad.mp3,1,zwei,3", "not a number")]
    log = T.success_log(parsed).collect()[0]
    assert (log["lines"], log["kept"], log["quarantined"]) == (4, 3, 1)
    short = T.parse(T.read_lines(spark, write(tmp_path, "short.rh", "a.mp3,1,2")), "rh", 3)
    assert short.collect()[0]["reason"] in ("wrong length", "no id", "not a number")


def test_beat_histogram_and_notes(spark, tmp_path):
    bh = write(tmp_path, "a.bh", "audio/a;b.mp3;  163.75; [0.  ,1.5, 2.]", "c.mp3; fast; [1.]", "d.mp3; 1; []")
    parsed = T.parse(T.read_lines(spark, bh), "bh", T.ANY_WIDTH)
    assert rows(T.good(parsed), "id", "bpm", "bh") == [("ab", 163.75, [0.0, 1.5, 2.0])]
    assert sorted(r["reason"] for r in T.quarantined(parsed).collect()) == ["no bpm", "not a number"]
    notes = write(
        tmp_path, "a.notes", "audio/a.mp3; E; major; [2, 10, 11, 1, 0]", "b.mp3; C; minor; [12]", "c.mp3; C; minor; oops"
    )
    parsed = T.parse(T.read_lines(spark, notes), "notes")
    assert rows(T.good(parsed), "id", "key", "scale", "notes") == [("a", "E", "major", "CKLBA")]
    assert {r["reason"] for r in T.quarantined(parsed).collect()} == {"not a note list"}


def matrix(value, beats=2, pitches=12):
    return "[" + ",".join("[" + ",".join(str(value + i + j / 10) for j in range(beats)) + "]" for i in range(pitches)) + "]"


def test_chroma_lines(spark, tmp_path):
    good = matrix(0.0)
    path = write(
        tmp_path, "a.chroma", f"audio/a;b.mp3; {good}", "c.wav; []", "d.mp3; [[2.0,1.0]]", f"e.mp3; {matrix(0.0, 2, 11)}"
    )
    parsed = T.parse(T.read_lines(spark, path), "chroma")
    kept = T.good(parsed).collect()
    assert [r["id"] for r in kept] == ["ab"] and len(kept[0]["chroma"]) == 24 and kept[0]["chroma"][3] == 1.1
    assert sorted(r["reason"] for r in T.quarantined(parsed).collect()) == [
        "empty or not a chroma matrix",
        "empty or not a chroma matrix",
        "not twelve rows",
    ]


def test_mfcc_lines(spark, tmp_path):
    path = write(tmp_path, "a.mfcckl", "a.mp3; [1, 2]; [[1., 0.],[0. , 2.]]", "b.mp3; [1, 2]; [[1.,0.]]")
    parsed = T.parse(T.read_lines(spark, path), "mfcckl", 2)
    assert rows(T.good(parsed), "id", "mfcc") == [("a", [1, 2, 1, 0, 0, 2])]
    euclid = write(tmp_path, "a.mfcc", "a.mp3; [1, 2]; [3, 4]; [5, 6, 7]", "b.mp3; [1, 2]; [3, 4]; [6]", "c.mp3; [1]; [3]; [6]")
    parsed = T.parse(T.read_lines(spark, euclid), "mfcc", 2)
    assert rows(T.good(parsed), "id", "mfcc_euclid") == [("a", [1, 2, 3, 4, 5, 6, 7]), ("b", [1, 2, 3, 4, 6])]
    parts = [write(tmp_path, n, *lines) for n, lines in {
        "m": ["a.mp3; [1, 2]", "b.mp3; [1, 1]"], "v": ["a.mp3; [3, 4]", "b.mp3; [0, 0]"], "c": ["a.mp3; [5]", "b.mp3; [9]", "z.mp3; [1]"]
    }.items()]
    assert rows(T.read_part_files(spark, *parts), "id", "mfcc_euclid") == [("a", [1, 2, 3, 4, 5]), ("b", [1, 1, 0, 0, 9])]


def test_long_vectors_parse(spark, tmp_path):
    values = ",".join(f"b'{i / 7}'" for i in range(1440))
    path = write(tmp_path, "a.rp", f"b'x/y.mp3',{values}")
    got = T.read_features(spark, path, "rp", T.LENGTHS["rp"], partitions=3).collect()
    assert got[0]["id"] == "xy" and got[0]["rp"] == [i / 7 for i in range(1440)]


def test_shards_are_read_by_glob_and_assembled(spark, tmp_path):
    for shard in ("features0", "features1"):
        (tmp_path / shard).mkdir()
        n = shard[-1]
        write(tmp_path / shard, f"out{n}.rh", f"a{n}.mp3,1,2", f"b{n}.mp3,3,4")
        write(tmp_path / shard, f"out{n}.notes", f"a{n}.mp3; A; major; [0, 1]")
        write(tmp_path / shard, f"out{n}.bh", f"a{n}.mp3; 100; [1.]", f"a{n}.mp3; 100; [1.]", f"b{n}.mp3; 90; [1.]")
    wide = build.ingest(spark, f"{tmp_path}/features[0-9]*", ("rh", "notes", "bh"), widths=ANY)
    assert rows(wide, "id", "notes", "bpm") == [("a0", "AB", 100.0), ("a1", "AB", 100.0)]
    left = build.ingest(spark, f"{tmp_path}/features[0-9]*", ("rh", "notes", "bh"), how="left", widths=ANY)
    assert [r[0] for r in rows(left.na.fill("", ["notes"]), "id", "notes")] == ["a0", "a1", "b0", "b1"]


def test_written_features_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "C", "major", "ABKL"), ("b", "D", "minor", "C")], "id string, key string, scale string, notes string")
    T.write_features({"notes": df}, str(tmp_path), "overwrite")
    T.write_features({"notes": df.limit(1).withColumn("id", F.lit("c"))}, str(tmp_path))
    back = T.read_features(spark, f"{tmp_path}/feature=notes", "notes")
    assert rows(back, "id", "notes") == [("a", "ABKL"), ("b", "C"), ("c", "ABKL")]


def test_id_functions(spark):
    df = spark.createDataFrame(
        [("ab/Rock/x_1.mp3",), ("cd/Pop/.hidden.wav",), ("Jazz/y.FLAC",), ("Jazz/y.txt",)], "p string"
    )
    out = df.select(
        ids.strip_bucket(F.col("p")).alias("b"), ids.class_from_path(F.col("p"), 0).alias("c"), ids.base_name(F.col("p")).alias("n"),
        ids.strip_extension(F.col("p")).alias("e"), ids.is_audio(F.col("p")).alias("a"), ids.shard_of(F.col("p")).alias("s"),
    ).collect()
    assert out[0].asDict() == {"b": "Rock/x_1.mp3", "c": "ab", "n": "x_1.mp3", "e": "ab/Rock/x_1", "a": True, "s": "p3"}
    assert [r["a"] for r in out] == [True, False, True, False]


@pytest.mark.parametrize("key,shift", [("A", 0), ("A#", 11), ("Bb", 11), ("G#", 1), ("Ab", 1), ("C", 9), ("Eb", 6)])
def test_keys(spark, key, shift):
    df = spark.createDataFrame([([0, 3, 11], [[float(i)] for i in range(12)], key)], "n array<int>, c array<array<double>>, k string")
    got = df.select(symbols.transpose_notes(F.col("n"), F.col("k")).alias("n"), symbols.transpose_chroma(F.col("c"), F.col("k")).alias("c")).collect()[0]
    assert got["n"] == [(v + shift) % 12 for v in (0, 3, 11)]
    moved = [0.0] * 12
    for i in range(12):
        moved[(i + shift) % 12] = float(i)
    assert [r[0] for r in got["c"]] == moved


def test_class_files(spark, tmp_path):
    path = write(tmp_path, "classes.txt", "a/x.mp3\tRock", "b/y.v2.mp3\tPop")
    assert rows(tabular.read_classes(spark, path), "id", "class") == [("a/x.mp3", "Rock"), ("b/y.v2.mp3", "Pop")]
    assert rows(tabular.read_classes(spark, path, cut_path=True, cut_ext=True), "id") == [("x",), ("y.v2",)]
    multi = write(tmp_path, "multi.txt", "file\trock\tpop", "a/x.mp3\tx\t", "y.mp3\tx\tx", "z.mp3\t?\t0")
    got = tabular.read_class_table(spark, multi, cut_ext=True)
    assert got.columns == ["id", "rock", "pop"]
    assert {r["id"]: (r["rock"], r["pop"]) for r in got.collect()} == {"x": (1, 0), "y": (1, 1), "z": (None, 0)}


def test_numeric_csv_id_positions(spark, tmp_path):
    path = write(tmp_path, "f.csv", "1,2,a", "3,4,b")
    assert rows(tabular.read_numeric_csv(spark, path, -1), "id", "features") == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    assert rows(tabular.read_numeric_csv(spark, path, [-1, 0], ids_only=True), "id_0", "id_1") == [("a", "1"), ("b", "3")]
    both = tabular.read_many(spark, [path, write(tmp_path, "g.csv", "5,6,c")], id_cols=-1)
    assert both.count() == 3


def test_playlists(spark, tmp_path):
    for i, uris in enumerate((["A", "B"], ["B", "C"])):
        doc = {"info": {}, "playlists": [{"name": "x", "tracks": [{"track_uri": f"service:track:{u}"} for u in uris]}]}
        (tmp_path / f"slice.{i}.json").write_text(json.dumps(doc, indent=1))
    assert rows(tabular.playlist_track_ids(spark, f"{tmp_path}/slice.*.json"), "id") == [("A",), ("B",), ("C",)]


def test_result_lists_keep_their_file(spark, tmp_path):
    head = ",id,key,scale,bpm,scaled_rp,scaled_rh,scaled_bh,scaled_notes,scaled_chroma,scaled_skl,scaled_js,scaled_mfcc,aggregated"
    for name in ("q1", "q2"):
        write(tmp_path, f"{name}.csv", head, f"0,music/Pop/{name}.mp3,C,major,120,0,0,0,0,0,0,0,0,0.0")
    got = tabular.read_result_lists(spark, str(tmp_path))
    assert rows(got, "query", "id", "bpm") == [("q1", "music/Pop/q1.mp3", 120.0), ("q2", "music/Pop/q2.mp3", 120.0)]


def test_result_lists_named_by_their_folder(spark, tmp_path):
    for name in ("query=7", "a b"):
        (tmp_path / name).mkdir()
        write(tmp_path / name, "part-0.csv", "rank,id,aggregated", "1,7,0.0", "2,9,0.5")
    got = tabular.read_result_lists(spark, str(tmp_path), "rank int, id long, aggregated double", named="folder")
    assert rows(got, "query", "rank", "id") == [("7", 1, 7), ("7", 2, 9), ("a b", 1, 7), ("a b", 2, 9)]


def test_evaluation_of_stored_lists(spark, tmp_path):
    for name, ids_ in (("1", [1, 2, 3, 4]), ("4", [4, 3, 1, 2])):
        write(tmp_path, f"{name}.tsv", "id\taggregated", *[f"{x}\t{i / 10}" for i, x in enumerate(ids_)])
    classes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id long, class string")
    schema = "id long, aggregated double"
    lists = tabular.read_result_lists(spark, str(tmp_path), schema, sep="\t")
    first = evaluate.among_first(evaluate.labelled_lists(lists, classes), 2)
    assert rows(first, "query_id", "rank", "id") == [("1", 1, "2"), ("1", 2, "3"), ("4", 1, "3"), ("4", 2, "1")]
    hits = rows(evaluate.pair_hits(first, (1, 2)), "original", "detected", "hits_1", "hits_2")
    assert hits == [("a", "a", 1, 1), ("a", "b", 0, 1), ("b", "a", 0, 1), ("b", "b", 1, 1)]
    out = f"{tmp_path}/counts"
    for _ in range(2):  # the second run has no new files and changes nothing
        stream = tabular.read_result_lists(spark, f"{tmp_path}/*.tsv", schema, sep="\t", stream=True)
        ingest.count_lists(stream, classes, out, f"{tmp_path}/progress").awaitTermination()
        whole = rows(evaluate.confusion(evaluate.labelled_lists(lists, classes)), "original", "detected", "n")
        assert rows(spark.read.parquet(out), "original", "detected", "n") == whole and sum(r[2] for r in whole) == 6


def test_all_kinds_come_back_bit_by_bit(spark, tmp_path):
    values = [0.0005, 1.5, 3e-12, 0.1 + 0.2, 7.25e9, -4.0, 1e-300, 123456789.123, 0.0, -0.5, 1 / 3, 2.0, 1e22]

    def vector(n, shift=0):
        return [values[(i * 7 + shift) % 13] for i in range(n)]

    row = ("a; b/c.mp3", vector(1440), vector(60, 1), 97.5, vector(250, 2), vector(182, 3), vector(117), vector(104, 5), "C", "minor", "ABL")
    schema = "id string, rp array<double>, rh array<double>, bpm double, bh array<double>, mfcc array<double>, "
    schema += "mfcc_euclid array<double>, older array<double>, key string, scale string, notes string"
    df = spark.createDataFrame([row], schema).withColumn("chroma", F.slice("rp", 1, 288))
    for kind, column in (("rp", "rp"), ("rh", "rh"), ("bh", "bh"), ("chroma", "chroma"), ("mfcckl", "mfcc"), ("mfcc", "mfcc_euclid"), ("notes", "notes")):
        T.to_lines(df, kind).write.text(f"{tmp_path}/{kind}")
        parsed = T.parse(T.read_lines(spark, f"{tmp_path}/{kind}"), kind)
        assert [r["reason"] for r in parsed.collect()] == [None]
        back = T.good(parsed).first()
        assert back["id"] == "abc" and back[column] == df.first()[column]
    older = df.drop("mfcc_euclid").withColumnRenamed("older", "mfcc_euclid")
    T.to_lines(older, "mfcc").write.text(f"{tmp_path}/older")  # a triangle without its diagonal
    assert T.read_features(spark, f"{tmp_path}/older", "mfcc").first()["mfcc_euclid"] == row[7]
    assert T.read_features(spark, f"{tmp_path}/bh", "bh").first()["bpm"] == 97.5


def test_lengths_are_checked_unless_told_otherwise(spark, tmp_path):
    path = write(tmp_path, "a.rh", "a.mp3,1,2", "b.mp3," + ",".join(["0.5"] * 60), "c.mp3," + ",".join(["1"] * 59 + ["Infinity"]))
    lines = T.read_lines(spark, path)
    reasons = {r["id"]: r["reason"] for r in T.parse(lines, "rh").collect()}
    assert reasons["b"] is None and reasons["c"] == "not a number" and list(reasons.values()).count(None) == 1
    assert [r["id"] for r in T.good(T.parse(lines, "rh", 2)).collect() if r["rh"] == [1.0, 2.0]] == ["a"]
    assert {r["id"] for r in T.good(T.parse(lines, "rh", T.ANY_WIDTH)).collect()} == {"a", "b"}


def test_audio_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.mp3", "sub/b.WAV", ".c.mp3", "d.txt"):
        (tmp_path / name).write_bytes(b"12")
    got = tabular.list_audio(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got.collect()) == ["a.mp3", "b.WAV"]


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("left_features", "right_features"):
            df = spark.range(100).withColumnRenamed("id", "id")
            tabular.save_bucketed(df.withColumn(name, F.col("id")), name, 4, path=f"{tmp_path}/{name}")
        joined = spark.table("left_features").join(spark.table("right_features"), "id")
        assert joined.count() == 100
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("left_features", "right_features"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_catalogue_lookup_skips_row_groups(spark, tmp_path):
    tabular.write_catalogue(spark.range(1000).select(F.col("id").cast("string")), f"{tmp_path}/c")
    assert tabular.read_catalogue(spark, f"{tmp_path}/c").filter("id = '7'").count() == 1
