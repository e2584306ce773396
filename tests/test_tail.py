"""Growing, rotating log files: every whole line once, whatever happens between two triggers."""

import os
import random

from eventlens.session import new_path
from eventlens.sources import readers as R
from eventlens.sources.tail import LogTailReader, changes, tail
from eventlens.streaming.runner import run_to_now


def read(reader, start, end):
    return [row for piece in reader.partitions(start, end) for batch in reader.read(piece) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]


def test_every_whole_line_once(tmp_path):
    rng = random.Random(3)
    live, names = tmp_path / "app.log", 0
    written, seen, half = [], [], ""
    reader = LogTailReader({"path": f"{tmp_path}/app*", "pieceBytes": "37"})
    at = reader.initialOffset()
    for step in range(60):
        with open(live, "ab") as f:
            for _ in range(rng.randrange(4)):
                line = f"{half}line {len(written)} {'x' * rng.randrange(80)}é"
                f.write((line.removeprefix(half) + rng.choice(["\n", "\r\n"])).encode())
                written.append(line)
                half = ""
            if not half and rng.random() < 0.3:
                half = "half "
                f.write(half.encode())
        if rng.random() < 0.5:
            now = reader.latestOffset()
            seen += [r[2] for r in read(reader, at, now)]
            assert sorted(seen) == sorted(written)
            at = now
            if rng.random() < 0.3:
                reader = LogTailReader({"path": f"{tmp_path}/app*", "pieceBytes": str(rng.choice([1, 20, 10**6]))})  # restarted: only the offset is left
        if not half and rng.random() < 0.2:
            names += 1
            os.rename(live, tmp_path / f"app.log.{names}")
    assert names > 3 and len(written) > 40


def test_positions_are_those_of_the_bytes(tmp_path):
    data = "é\n\n" + "y" * 200_000 + "\nlast\nhalf".encode().decode()
    (tmp_path / "a.log").write_bytes(data.encode())
    reader = LogTailReader({"path": str(tmp_path), "pieceBytes": "1000"})
    rows = read(reader, {"files": {}}, reader.latestOffset())
    assert [r[2] for r in rows] == ["é", "", "y" * 200_000, "last"]
    assert all(data.encode()[p : p + len(v.encode())] == v.encode() for _, p, v in rows)


def test_truncated_replaced_and_ignored_files(tmp_path):
    reader = LogTailReader({"path": f"{tmp_path}/*.log"})
    a = tmp_path / "a.log"
    a.write_text("one\ntwo\n")
    (tmp_path / "a.txt").write_text("no\n")
    first = reader.latestOffset()
    a.write_text("new\n")  # truncated and written anew
    (tmp_path / ".b.log").write_text("hidden\n")
    (tmp_path / "empty.log").write_text("")
    second = reader.latestOffset()
    assert [r[2] for r in read(reader, first, second)] == ["new"]
    a.unlink()
    assert changes(second["files"], reader.latestOffset()["files"]) == {}


def test_replay_after_rotation(tmp_path):
    """A batch that failed is read again, though its file has another name by then."""
    reader = LogTailReader({"path": str(tmp_path)})
    (tmp_path / "a").write_text("one\ntwo\n")
    end = reader.latestOffset()
    os.rename(tmp_path / "a", tmp_path / "z")
    (tmp_path / "a").write_text("other\n")
    assert [r[2] for r in read(reader, {"files": {}}, end)] == ["one", "two"]


def test_latest_skips_what_was_there(tmp_path):
    (tmp_path / "a").write_text("old\n")
    reader = LogTailReader({"path": str(tmp_path), "startingPosition": "latest"})
    start = reader.initialOffset()
    with open(tmp_path / "a", "a") as f:
        f.write("new\n")
    assert [r[2] for r in read(reader, start, reader.latestOffset())] == ["new"]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    out, checkpoint = new_path(spark, "tail"), new_path(spark, "tail-checkpoint")
    log = tmp_path / "app.log"
    log.write_text("query a\nnoise\nhal")
    for more in ("f query b\n", None, "DHCPACK\n"):
        got = run_to_now(R.read_log_stream(spark, str(tmp_path), "dns", "dhcp"), "tail", checkpoint, out)
        if more is None:
            os.rename(log, tmp_path / "app.log.1")
            log.write_text("query c\n")
        else:
            with open(log, "a") as f:
                f.write(more)
    got = run_to_now(R.read_log_stream(spark, str(tmp_path), "dns", "dhcp"), "tail", checkpoint, out)
    assert sorted((r.source, r.message) for r in got.collect()) == [("dhcp", "DHCPACK"), ("dns", "half query b"), ("dns", "query a"), ("dns", "query c")]
    rows = run_to_now(tail(spark, f"{tmp_path}/app.log"), "whole").collect()
    assert [(r.position, r.value) for r in rows] == [(0, "query c"), (8, "DHCPACK")]
