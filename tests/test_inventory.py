import gzip
import hashlib
import random

import pytest

from weighbridge.sources import carried, files


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Splits of 700 bytes, and files of over 5,000 bytes can't be read whole: in place of 128 MB and 2 GB."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5000")
    monkeypatch.setattr(files, "WHOLE_BYTES", 1000, raising=False)
    monkeypatch.setattr(carried, "LINE_BYTES", 3000)
    monkeypatch.setattr(carried, "SPLIT_BYTES", 700)
    yield
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def made(folder):
    r = random.Random(3)
    noise = lambda n: r.randbytes(n)
    texts = {
        "noise.bin": noise(9_000), "other noise %20é.bin": noise(5_431), "more.bin": noise(7_000) + b"\n", "few.bin": noise(700), "edge.bin": noise(1_000), "over.bin": noise(1_001), "break.bin": b"\n",
        "breaks.bin": b"\n" * 9_000, "returns.bin": b"\r\n\r" * 3_000, "zeros.bin": bytes(8_000), "mark.bin": carried.MARK + noise(6_000), "mark_end.bin": carried.MARK + noise(6_000) + b"\n", "two_marks.bin": carried.MARK * 2 + b"a\n" * 3_000,
        "mark_breaks.bin": carried.MARK + b"\n" * 6_000, "half_mark.bin": carried.MARK[:2] + b"\n" + carried.MARK * 900, "no_breaks.bin": b"b" * 4_500, "words.bin": b"some words " * 500, "line.bin": b"a" * 2_800 + b"\n" + b"b" * 2_800 + b"\n", "multiple.bin": (b"x" * 699 + b"\n") * 10, "packed.gz": gzip.compress(noise(2_000)), "plain.bz2": noise(2_100),
    }
    (folder / "deep").mkdir()
    for n, (name, text) in enumerate(texts.items()):
        (folder / ("deep" if n % 2 else "") / name).write_bytes(text)
    return texts


def test_files_beyond_what_one_task_can_read(spark, tmp_path, small_splits):
    texts = made(tmp_path)
    got = files.inventory(spark, str(tmp_path)).collect()
    digest = {name: hashlib.sha256(text).hexdigest() for name, text in texts.items()}
    assert {r.name: (r.bytes, r.sha256) for r in got} == {name: (len(text), digest[name]) for name, text in texts.items()} and len(got) == len(texts)
    assert {r.all_sha256 for r in got} == {hashlib.sha256("\n".join(f"{name}:{digest[name]}" for name in sorted(texts, key=str.encode)).encode()).hexdigest()}


def test_a_task_reads_a_split(spark, tmp_path, small_splits, monkeypatch):
    (tmp_path / "in").mkdir()
    for name in "abc":
        (tmp_path / "in" / name).write_bytes(random.Random(name).randbytes(9_000 + 100 * ord(name)))
    step, log = carried._going_on, tmp_path / "read"
    log.mkdir()

    def watched(turn):
        inner = step(turn)

        def told(batches):
            n = [0]

            def counting():
                for b in batches:
                    n[0] += sum(map(len, b.column("bytes").to_pylist()))
                    yield b

            yield from inner(counting())
            (log / f"{random.SystemRandom().random()}").write_text(str(n[0]))

        return told

    monkeypatch.setattr(carried, "_going_on", watched)
    got = files.inventory(spark, str(tmp_path / "in")).collect()
    assert {r.sha256 for r in got} == {hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "in").iterdir()}
    read = [int(p.read_text()) for p in log.iterdir()]
    size = sum(p.stat().st_size for p in (tmp_path / "in").iterdir())
    assert max(read) < 4_000 and size <= sum(read) <= size + 3 and spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_a_state_goes_on_elsewhere():
    assert carried.available()
    text = random.Random(5).randbytes(1_000)
    state = b""
    for at in range(0, 1_000, 37):
        digest = carried.Digest(state)
        digest.update(text[at : at + 37])
        state = digest.state()
    assert carried.Digest(state).hexdigest() == carried.Digest(state).hexdigest() == hashlib.sha256(text).hexdigest()


def test_without_states_files_are_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE_BYTES", 10, raising=False)
    monkeypatch.setattr(carried, "available", lambda: False)
    (tmp_path / "a").write_bytes(b"a\n" * 50)
    assert [r.sha256 for r in files.inventory(spark, str(tmp_path)).collect()] == [hashlib.sha256(b"a\n" * 50).hexdigest()]
