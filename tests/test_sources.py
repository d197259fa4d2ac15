import hashlib
import io
import json
import os
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vlprep.config import SplitPaths
from vlprep.operators import images, split, tokens
from vlprep.sources import tables, tarshards
from vlprep.streaming import jobs


def add(tar, name, data):
    info = tarfile.TarInfo(name)
    info.size = len(data)
    tar.addfile(info, io.BytesIO(data))


def write_tar(path, samples, format=tarfile.PAX_FORMAT):
    with tarfile.open(path, "w", format=format) as tar:
        for key, members in samples:
            for extension, data in members.items():
                add(tar, f"{key}.{extension}", data)


def sample(i, caption="c", size=40):
    return (f"{i:05d}", {"jpg": bytes([i % 256]) * size, "json": json.dumps({"caption": caption}).encode()})


@pytest.fixture
def shards(tmp_path):
    write_tar(tmp_path / "b.tar", [sample(10), sample(11, None), ("00012", {"json": b"{}"}), sample(13)])
    write_tar(tmp_path / "a.tar", [sample(i) for i in range(4)])
    write_tar(tmp_path / "c.tar", [sample(20 + i) for i in range(4)])
    (tmp_path / "notes.txt").write_text("not a shard")
    return tmp_path


def test_listing(spark, shards):
    rows = tables.list_shards(spark, f"{shards}/*.tar").orderBy("shard_idx").collect()
    assert [os.path.basename(r.shard) for r in rows] == ["a.tar", "b.tar", "c.tar"]
    assert [r.shard_idx for r in rows] == [0, 1, 2] and rows[0].bytes == os.path.getsize(shards / "a.tar")
    with pytest.raises(ValueError):
        tables.list_shards(spark, f"{shards}/*.none")


def test_samples_group_members_by_key(spark, shards):
    rows = tarshards.with_captions(tarshards.read_shards(spark, f"{shards}/*.tar")).collect()
    got = {r.key: r for r in rows}
    assert len(rows) == 12 and all(r.error is None for r in rows)
    assert got["00003"].jpg == bytes([3]) * 40 and got["00003"].caption == "c"
    assert got["00011"].caption is None and got["00012"].jpg is None and got["00012"].json == "{}"
    assert os.path.basename(got["00010"].shard) == "b.tar"


def test_member_choice(spark, shards):
    df = tarshards.read_shards(spark, str(shards), columns="json")
    assert df.columns == ["shard", "key", "json", "error"] and df.count() == 12


def test_damaged_shard_is_skipped_or_fails(spark, shards):
    whole = (shards / "c.tar").read_bytes()
    (shards / "c.tar").write_bytes(whole[: 512 * 9 + 100])
    (shards / "d.tar").write_bytes(b"junk" * 300)
    df = tarshards.read_shards(spark, f"{shards}/*.tar")
    good = tarshards.good_samples(df)
    # two whole samples lie before the damage in c.tar
    assert sorted(r.key for r in good.collect()) == [f"{i:05d}" for i in (0, 1, 2, 3, 10, 11, 12, 13, 20, 21)]
    assert {os.path.basename(r.shard): r.n_errors for r in tarshards.shard_rejects(df).collect()} == {"c.tar": 1, "d.tar": 1}
    with pytest.raises(Exception, match="shard ends inside"):
        tarshards.read_shards(spark, f"{shards}/c.tar", on_error="fail").collect()


def test_no_shards(spark, tmp_path):
    with pytest.raises(Exception, match="no shards match"):
        tarshards.read_shards(spark, f"{tmp_path}/*.tar").collect()


@pytest.mark.parametrize("split_bytes", [512, 1000, 4096, 10_000, 1 << 20, 0])
@pytest.mark.parametrize("format", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, "old"])
def test_split_shards_give_every_sample_once(tmp_path, split_bytes, format):
    rng = np.random.default_rng(split_bytes)
    samples = []
    for i in range(40):
        key = f"{'long-' * 60 if i % 9 == 4 else ''}{i:05d}"
        members = {"jpg": rng.bytes(int(rng.integers(0, 5000))), "json": b"{}"}
        if i % 4 == 0:
            members["txt"] = b"x" * int(rng.integers(0, 3000))
        samples.append((key, members))
    if format == "old":
        # the first tar format has no mark in its headers
        samples = [(k[-5:], m) for k, m in samples]
        write_tar(tmp_path / "x.tar", samples, tarfile.USTAR_FORMAT)
        data = bytearray((tmp_path / "x.tar").read_bytes())
        at = 0
        while data[at]:
            head = data[at : at + 512]
            size = int(head[124:135], 8)
            head[257:512] = bytes(255)
            head[148:156] = b" " * 8
            head[148:156] = b"%06o\0 " % sum(head)
            data[at : at + 512] = head
            at += 512 + -(-size // 512) * 512
        (tmp_path / "x.tar").write_bytes(bytes(data))
    else:
        write_tar(tmp_path / "x.tar", samples, format)
    options = {"path": str(tmp_path / "x.tar"), "split_bytes": str(split_bytes), "on_error": "fail", "columns": "jpg,json,txt"}
    reader = tarshards.TarShardReader(options, tarshards.TarShards(options).schema())
    parts = reader.partitions()
    assert len(parts) > 1 or split_bytes in (0, 1 << 20)
    rows = [row for part in parts for batch in reader.read(part) for row in batch.to_pylist()]
    assert [r["key"] for r in rows] == [k for k, _ in samples]
    for r, (_, members) in zip(rows, samples):
        assert r["jpg"] == members["jpg"] and (r["txt"] or "").encode() == members.get("txt", b"")


def test_write_read_identity_and_shard_sizes(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(25).select("id", F.format_string("%05d", "id").alias("key"), F.encode(F.repeat(F.lit("z"), F.col("id").cast("int")), "utf-8").alias("jpg"),
                                F.to_json(F.struct(F.concat(F.lit("c"), "id").alias("caption"))).alias("json"))
    tarshards.write_shards(df, path, "id", rows_per_shard=10)
    names = shard_files(path)
    assert [n[:10] for n in names] == ["000000000-", "000000001-", "000000002-"]
    back = tarshards.with_captions(tarshards.read_shards(spark, path, on_error="fail")).orderBy("key").collect()
    assert [(r.key, len(r.jpg), r.caption) for r in back] == [(f"{i:05d}", i, f"c{i}") for i in range(25)]
    assert {os.path.basename(r.shard) for r in back[10:20]} == {names[1]}
    with tarfile.open(f"{path}/{names[1]}") as plain:
        assert plain.getnames() == [f"{i:05d}.{m}" for i in range(10, 20) for m in ("jpg", "json")]
        assert plain.extractfile("00012.json").read() == b'{"caption":"c12"}'
    with pytest.raises(Exception, match="shards exist already"):
        tarshards.write_shards(df, path, "id", rows_per_shard=10)
    assert listed(path) == names and tarshards.read_shards(spark, path).count() == 25
    tarshards.write_shards(df.limit(5), path, "id", rows_per_shard=10, mode="overwrite")
    assert len(listed(path)) == 1 and tarshards.read_shards(spark, f"{path}/*.tar").count() == 5
    assert tarshards.remove_unlisted(spark, path) == []
    assert set(tarshards.remove_unlisted(spark, path, older_than=0)) >= set(names)
    assert shard_files(path) == listed(path)


def shard_files(path):
    return sorted(n for n in os.listdir(path) if n.endswith(".tar"))


def listed(path):
    with open(f"{path}/_shards.json") as source:
        return [n for n, _, _ in json.load(source)["shards"]]


def test_shards_by_hash_key_and_one_shuffle_of_the_samples(spark, tmp_path):
    df = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("at"), F.format_string("%05d", "id").alias("key"), F.lit(b"z").alias("jpg")).repartition(5)
    tarshards.write_shards(df, f"{tmp_path}/a", "at", rows_per_shard=64)
    rows = tarshards.read_shards(spark, f"{tmp_path}/a", columns="jpg").collect()
    order = sorted(range(300), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert len(rows) == 300 and {r.key: int(os.path.basename(r.shard)[:9]) for r in rows} == {f"{i:05d}": n // 64 for n, i in enumerate(order)}
    plan = tarshards.place_in_shards(df, "at", 64)._jdf.queryExecution().executedPlan().toString()
    # what is exchanged on the way to the shard numbers holds no sample
    for line in plan.splitlines():
        assert not ("Exchange" in line and "jpg" in line)
    parts = tarshards.place_in_shards(df, "at", 64).repartition("shard_idx")._jdf.queryExecution().optimizedPlan().toString()
    assert parts.count("RepartitionByExpression") == 1


def test_rows_without_an_order_are_written(spark, tmp_path):
    df = spark.createDataFrame([(None, "n0", b"a"), (None, "n1", b"b"), *[(i, f"k{i}", b"c") for i in range(5)]], "at long, key string, jpg binary")
    tarshards.write_shards(df, f"{tmp_path}/a", "at", rows_per_shard=3)
    rows = tarshards.read_shards(spark, f"{tmp_path}/a", columns="jpg").collect()
    assert sorted(r.key for r in rows) == ["k0", "k1", "k2", "k3", "k4", "n0", "n1"]


def read_all(path, split_bytes, marks=(), on_error="skip"):
    options = {"path": str(path), "split_bytes": str(split_bytes), "on_error": on_error, "columns": "jpg,json"}
    reader = tarshards.TarShardReader(options, tarshards.TarShards(options).schema())
    parts = tarshards.ranges_of([tarshards.Shard(str(path), os.path.getsize(path), tuple(marks))], split_bytes)
    rows = [row for part in parts for batch in reader.read(part) for row in batch.to_pylist()]
    good = [(r["key"], r["jpg"], r["json"]) for r in rows if r["error"] is None]
    return len(parts), good, sorted(r["error"] for r in rows if r["error"] is not None)


@pytest.mark.parametrize("seed", range(12))
def test_damaged_shards_give_the_same_samples_however_they_are_cut(tmp_path, seed):
    rng = np.random.default_rng(seed)
    samples = [(f"{'long-' * 60 if i % 7 == 3 else ''}{i:05d}", {"jpg": rng.bytes(int(rng.integers(0, 9000))), "json": b"{}"}) for i in range(60)]
    write_tar(tmp_path / "x.tar", samples, tarfile.GNU_FORMAT if seed % 2 else tarfile.PAX_FORMAT)
    data = bytearray((tmp_path / "x.tar").read_bytes())
    for _ in range(seed // 2):
        at, n = int(rng.integers(0, len(data) - 20_000)), int(rng.integers(1, 20_000))
        data[at : at + n] = bytes(n) if rng.integers(2) else rng.bytes(n)
    for _ in range(seed // 3):  # single headers, and blank ones
        at = int(rng.integers(0, len(data) // 512)) * 512
        data[at : at + 512] = bytes(512) if rng.integers(2) else rng.bytes(512)
    if seed % 4 == 3:
        data = data[: int(len(data) * 0.8)]
    (tmp_path / "x.tar").write_bytes(bytes(data))
    _, want, faults = read_all(tmp_path / "x.tar", 0)
    assert len(want) > 20 and (faults or seed < 2)
    for split_bytes in (512, 5_000, 40_000, 1 << 20):
        n, got, found = read_all(tmp_path / "x.tar", split_bytes)
        assert got == want and found == faults
        assert n > 1 or split_bytes >= len(data)


def test_marked_shards_are_cut_at_marks_whatever_their_members_hold(spark, tmp_path):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as tar:
        for i in range(5):
            add(tar, f"{i}.json", b"{}" * 300)
    rows = [(i, f"{i:04d}", inner.getvalue() + bytes(512 * i), "{}") for i in range(30)]
    df = spark.createDataFrame(rows, "at long, key string, jpg binary, json string")
    tarshards.write_shards(df, f"{tmp_path}/a", "at", rows_per_shard=100, mark_bytes=20_000)
    (shard,) = tarshards.find_shards(f"{tmp_path}/a")
    assert len(shard.marks) > 5 and all(b - a >= 20_000 for a, b in zip((0, *shard.marks), shard.marks))
    want = [(k, j, t) for _, k, j, t in rows]
    for split_bytes in (1, 30_000, 100_000, 0):
        n, got, faults = read_all(shard.path, split_bytes, shard.marks)
        assert got == want and not faults and (n > 1 or split_bytes == 0)
    back = tarshards.read_shards(spark, f"{tmp_path}/a", split_bytes=30_000).collect()
    assert sorted((r.key, bytes(r.jpg), r.json) for r in back) == want


def test_lost_attempts_are_not_seen(spark, tmp_path):
    options = {"path": f"{tmp_path}/a"}
    schema = T.StructType([T.StructField("shard_idx", T.LongType()), T.StructField("key", T.StringType()), T.StructField("json", T.StringType())])
    writer = tarshards.TarShardWriter(options, schema, False)
    batch = lambda k: iter([pa.RecordBatch.from_pylist([{"shard_idx": 0, "key": k, "json": "{}"}])])
    lost, won = writer.write(batch("lost")), writer.write(batch("won"))
    assert len(shard_files(tmp_path / "a")) == 2 and lost.shards != won.shards
    writer.commit([won, None])
    assert [r.key for r in tarshards.read_shards(spark, f"{tmp_path}/a", columns="json").collect()] == ["won"]
    with pytest.raises(ValueError, match="two tasks"):
        tarshards.TarShardWriter(options, schema, True).commit([lost, won])
    writer.abort([won])
    assert len(shard_files(tmp_path / "a")) == 1


def test_tasks_grow_with_the_bytes_and_not_with_the_ranges(tmp_path):
    """Many small shards cut into many ranges go to few tasks, which read each sample once."""
    for i in range(100):
        write_tar(tmp_path / f"{i:03d}.tar", [sample(10 * i + j, f"c {i} {j}", 700) for j in range(10)])
    options = {"path": str(tmp_path), "split_bytes": "2048", "columns": "json"}
    reader = tarshards.TarShardReader(options, tarshards.TarShards(options).schema())
    parts = reader.partitions()
    n = len(tarshards.ranges_of(tarshards.find_shards(str(tmp_path)), 2048))
    assert n > 800 and tarshards.LEAST_TASKS <= len(parts) <= 2 * tarshards.LEAST_TASKS
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["key"] for r in rows] == [f"{i:05d}" for i in range(1000)] and not any(r["error"] for r in rows)
    size = 1 << 20
    tasks = tarshards.tasks_of([tarshards.ShardRange(f"{i // 4}", i % 4 * size, (i % 4 + 1) * size, i % 8 < 4) for i in range(20_000)])
    assert max(sum(r.end - r.start for r in t.ranges) for t in tasks) <= tarshards.TASK_BYTES
    assert len(tasks) == 20_000 * size // tarshards.TASK_BYTES + 1


def test_stream_of_shards_equals_batch_and_reads_none_twice(spark, tmp_path):
    folder, log, out, state = (f"{tmp_path}/{n}" for n in ("in", "log", "out", "state"))
    os.mkdir(folder)

    def run():
        stream = tarshards.with_captions(tarshards.good_samples(tarshards.stream_shards(spark, folder, log, split_bytes=3000)))
        jobs.stream_prepare(stream, out, state, text="caption").awaitTermination()

    captions = [f"two words {i}" for i in range(20)]
    write_tar(f"{folder}/m.tar", [sample(i, captions[i], 900) for i in range(10)])
    run()
    assert spark.read.parquet(out).count() == 10
    run()  # nothing new
    write_tar(f"{folder}/b.tar", [sample(i, captions[i]) for i in range(10, 15)])  # sorts before the one that was read
    write_tar(f"{folder}/z.tar", [sample(15, "single"), sample(16, None)])
    run()
    batch = tokens.caption_tokens(tarshards.with_captions(tarshards.good_samples(tarshards.read_shards(spark, folder))), "caption")
    fields = ["shard", "key", "caption", "tokens"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*fields).collect()))
    assert got == sorted(map(tuple, batch.select(*fields).collect())) and len(got) == 16


def test_admissions_outlive_a_restart(tmp_path):
    for n in "abc":
        write_tar(tmp_path / f"{n}.tar", [sample(1)])
    options = {"path": f"{tmp_path}/*.tar", "log": f"{tmp_path}/log", "max_shards": "2"}
    reader = lambda: tarshards.TarShardStreamReader(options, tarshards.TarShards(options).schema())
    names = lambda r, a, b: [os.path.basename(p.path) for p in r.partitions({"admitted": a}, {"admitted": b})]
    first = reader()
    assert first.initialOffset() == {"admitted": 0} and first.latestOffset() == {"admitted": 1}
    # lost before its offset was kept: the admission stands
    again = reader()
    assert again.latestOffset() == {"admitted": 2} and names(again, 0, 1) == ["a.tar", "b.tar"] and names(again, 1, 2) == ["c.tar"]
    assert reader().latestOffset() == {"admitted": 2}
    write_tar(tmp_path / "0.tar", [sample(1)])
    last = reader()
    assert last.latestOffset() == {"admitted": 3} and names(last, 0, 3) == ["a.tar", "b.tar", "c.tar", "0.tar"]
    with pytest.raises(ValueError, match="lacks admission"):
        last.partitions({"admitted": 0}, {"admitted": 9})


def test_read_split(spark, shards, tmp_path):
    tarshards.register(spark)
    paths = SplitPaths(train=f"{shards}/[ab].tar", val=f"{shards}/c.tar")
    assert tables.read_split(spark, paths, "train").count() == 8
    assert tables.read_split(spark, paths, "val").count() == 4
    with pytest.raises(ValueError):
        tables.read_split(spark, paths, "test")


DOCS = [
    {"image_id": i, "conversations": [{"topic": "t", "content": [{"from": "user", "value": f'say "image_id": {i} }}, {{ ok?'}, {"from": "gpt", "value": "}"}]}]}
    for i in range(30)
]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("layout", ["array", "split"])
def test_dialogue_arrays(spark, tmp_path, indent, layout):
    (tmp_path / "d.json").write_text(json.dumps(DOCS, indent=indent))
    (tmp_path / "e.json").write_text(json.dumps([{**DOCS[0], "image_id": 99}], indent=indent) + "\n")
    rows = tables.read_dialogues(spark, str(tmp_path), layout).collect()
    assert sorted(r.image_id for r in rows) == [*range(30), 99]
    first = next(r for r in rows if r.image_id == 7)
    assert first.conversations[0].content[0].value == 'say "image_id": 7 }, { ok?'
    assert first.conversations[0].content[1]["from"] == "gpt"


def test_split_layout_reads_one_file_in_many_tasks(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DOCS * 50))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = tables.read_dialogues(spark, str(tmp_path), "split")
        assert df.count() == 1500 and df.select("image_id").distinct().count() == 30
        assert df.select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("text", [
    '[{"topic": 1, "image_id": 1, "conversations": []}, {"topic": 1, "image_id": 2, "conversations": []}]',
    '[{"image_id": 1, "conversations": [{"topic": "image_id", "content": []}]}]',
    '[{"image_id": 1, "conversations": [',
    '[{"conversations": []}]',
])
def test_split_layout_fails_rather_than_losing_documents(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(Exception):
        tables.read_dialogues(spark, str(tmp_path), "split").collect()


def test_dialogue_lines_roundtrip_and_bad_documents(spark, tmp_path):
    df = spark.createDataFrame(DOCS, tables.DIALOGUE)
    tables.write_dialogue_lines(df, f"{tmp_path}/lines")
    assert sorted(tables.read_dialogues(spark, f"{tmp_path}/lines", "lines").collect()) == sorted(df.collect())
    (tmp_path / "bad.json").write_text('{"image_id": "x')
    with pytest.raises(Exception):
        tables.read_dialogues(spark, f"{tmp_path}/bad.json", "lines").collect()
    with pytest.raises(ValueError):
        tables.read_dialogues(spark, "x", "csv")


def test_run_log(spark, tmp_path):
    df = spark.createDataFrame([(0, "train", 1.25), (0, "val", 2.0), (1, "train", 0.1234567)], "step bigint, split string, loss double")
    tables.write_run_log(df, f"{tmp_path}/log")
    tables.write_run_log(df.limit(1), f"{tmp_path}/log")
    assert sorted(tuple(r) for r in tables.read_run_log(spark, f"{tmp_path}/log").collect()) == [
        (0, "train", 1.25), (0, "train", 1.25), (0, "val", 2.0), (1, "train", 0.123457)
    ]
    (tmp_path / "log" / "part-x.txt").write_text("1 train\n2 test 0.5\nx train 1\n3 val y\n4 val 0.5 6\n\n5 val 0.5\n")
    assert tables.read_run_log(spark, f"{tmp_path}/log").count() == 5
    assert tables.run_log_rejects(spark, f"{tmp_path}/log").count() == 6


def test_metadata_scan_reads_only_what_it_needs(spark, tmp_path):
    df = spark.createDataFrame([("u", "t", "UNLIKELY", 0.3, "?")], "URL string, TEXT string, NSFW string, similarity double, LICENSE string")
    df.write.parquet(f"{tmp_path}/m")
    out = tables.read_metadata(spark, f"{tmp_path}/m", keep=["NSFW", "similarity"])
    assert [tuple(r) for r in out.collect()] == [("UNLIKELY", 0.3, "u", "t")]
    plan = out.filter(F.col("similarity") > 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "LICENSE" not in plan and "GreaterThan(similarity,0.2)" in plan


def test_batch_sink_keeps_batches_in_one_file_and_in_order(spark, tmp_path):
    df = spark.range(200).select("id", F.when(F.col("id") < 150, "train").otherwise("val").alias("split"),
                                 (F.col("id") % 2).alias("rank"), F.expr("id div 8").alias("batch_id"), (F.col("id") % 8).alias("pos"))
    tables.write_batches(df, f"{tmp_path}/b")
    back = spark.read.parquet(f"{tmp_path}/b").withColumn("file", F.input_file_name())
    assert back.count() == 200 and back.groupBy("split", "rank", "batch_id").agg(F.countDistinct("file").alias("n")).filter("n > 1").count() == 0
    for r in back.select("file").distinct().collect():
        path = r.file.replace("file://", "")
        rows = [(x.batch_id, x.pos) for x in spark.read.parquet(path).collect()]
        assert rows == sorted(rows)


# ---- images ---------------------------------------------------------------


def png(pixels):
    height, width, channels = pixels.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    pixels = {"1": rng.integers(0, 256, (4, 4, 3), dtype=np.uint8), "2": rng.integers(0, 256, (4, 4, 1), dtype=np.uint8)}
    pixels["3"] = np.concatenate([rng.integers(0, 256, (4, 4, 3), dtype=np.uint8), np.full((4, 4, 1), 255, np.uint8)], axis=2)
    for name, p in pixels.items():
        (tmp_path / f"{name}.png").write_bytes(png(p))
    (tmp_path / "4.png").write_bytes(b"junk")
    rgb = {n: (np.repeat(p, 3, axis=2) if p.shape[2] == 1 else p[:, :, :3]) for n, p in pixels.items()}
    return tmp_path, rgb


def test_image_folder(spark, folder):
    path, rgb = folder
    rows = {r.image_id: r.image for r in tables.read_images(spark, str(path)).collect()}
    assert set(rows) == {"1", "2", "3"}
    for name, im in rows.items():
        assert np.array_equal(images.to_rgb(im.data, im.height, im.width, im.nChannels), rgb[name])
    kept = {r.image_id: r.image.width for r in tables.read_images(spark, str(path), on_error="keep").collect()}
    assert kept["4"] == -1
    assert {r.image_id for r in tables.existing_images(spark, str(path), "png").collect()} == {"1", "2", "3", "4"}


def test_normalise_resize_patch(spark, folder):
    path, rgb = folder
    df = tables.read_images(spark, str(path), on_error="keep")
    got = {r.image_id: r.pixels for r in images.normalize_images(df).collect()}
    assert got["4"] is None
    mean, std = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
    for name, p in rgb.items():
        expected = ((p / 255 - mean) / std).transpose(2, 0, 1).reshape(-1)
        assert got[name] == pytest.approx(list(expected), abs=1e-5)

    small = {r.image_id: r.image for r in images.resize_images(df, 2).collect()}
    assert small["4"] is None
    for name, p in rgb.items():
        expected = np.floor(p.reshape(2, 2, 2, 2, 3).mean(axis=(1, 3)) + 0.5)
        assert np.array_equal(images.to_rgb(small[name].data, 2, 2, 3), expected)
    same = {r.image_id: r.image for r in images.resize_images(df, 4, "nearest").collect()}
    assert np.array_equal(images.to_rgb(same["2"].data, 4, 4, 3), rgb["2"])
    with pytest.raises(ValueError):
        images.resize_images(df, 4, "cubic")

    flat = images.normalize_images(df, mean=(0, 0, 0), std=(1, 1, 1)).withColumns({"height": F.lit(4), "width": F.lit(4)})
    patches = {(r.image_id, r.patch): r["values"] for r in images.patchify(flat, "image_id", 2).collect()}
    assert len(patches) == 12
    expected = (rgb["1"] / 255)[2:4, 0:2].transpose(2, 0, 1).reshape(-1)
    assert patches["1", 2] == pytest.approx(list(expected), abs=1e-6)


def test_patches_of_full_size_image(spark):
    df = spark.createDataFrame([(1, [0.5] * (3 * 224 * 224), 224, 224)], "id bigint, pixels array<float>, height int, width int")
    out = images.patchify(df, "id")
    assert out.count() == 196 and out.agg(F.min(F.size("values")), F.max("patch")).first()[:] == (768, 195)


def test_decoding_with_a_loader(spark):
    def loader():
        def decode(data):
            return np.frombuffer(data, dtype=np.uint8).reshape(2, 2, -1)

        return decode

    rows = [(1, bytes(range(12))), (2, bytes(range(4))), (3, bytes(range(16))), (4, b"xyz"), (5, None)]
    df = spark.createDataFrame(rows, "id int, jpg binary")
    got = {r.id: r.image for r in images.decode_images(df, loader).collect()}
    assert got[4] is None and got[5] is None
    rgb = lambda im: images.to_rgb(im.data, 2, 2, 3)
    assert np.array_equal(rgb(got[1]), np.arange(12).reshape(2, 2, 3))
    assert np.array_equal(rgb(got[2])[:, :, 1], np.arange(4).reshape(2, 2))
    assert np.array_equal(rgb(got[3]), np.arange(16).reshape(2, 2, 4)[:, :, :3])
    with pytest.raises(Exception):
        images.decode_images(df, loader, on_error="fail").collect()


def test_attach_images(spark):
    samples = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "image_id int, t string")
    pictures = spark.createDataFrame([(1, b"x"), (3, b"y")], "image_id int, data binary")
    assert sorted(r.t for r in images.attach_images(samples, pictures).collect()) == ["a", "b"]


def test_ranks_of_listed_shards(spark, shards):
    listed = tables.list_shards(spark, f"{shards}/*.tar").drop("shard_idx")
    rows = split.assign_ranks(listed, "shard", 2).orderBy("shard").collect()
    assert [r["rank"] for r in rows] == [0, 1, 0]
