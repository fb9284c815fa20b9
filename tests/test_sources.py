"""Readers over files laid out by host, with the awkward rows each source has."""

import hashlib
import json
import random
import struct
from datetime import datetime, timezone

import pytest

from traceloom import functions as X
from traceloom.sources import host as HO
from traceloom.sources import linux as LX
from traceloom.sources import ranges as RG
from traceloom.sources import reference_tables as RT
from traceloom.sources import windows as WN

WINDOW = (datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 1, 31, tzinfo=timezone.utc))
EPOCH = 1704110400      # 2024-01-01 12:00


def put(root, name, text, host="h1"):
    path = root / f"endpoint={host}" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def record(**fields):
    return json.dumps({"_BOOT_ID": "b", "_UID": "0", **fields})


def test_journal(spark, tmp_path):
    us = EPOCH * 1_000_000
    lines = [
        record(__CURSOR="c1", __REALTIME_TIMESTAMP=str(us), _PID="10", _EXE="/usr/sbin/cron", _COMM="cron",
               _SYSTEMD_UNIT="cron.service"),
        record(__CURSOR="c2", __REALTIME_TIMESTAMP=str(us + 60_000_000), _PID="10", _EXE="/usr/sbin/cron"),
        record(__CURSOR="c3", __REALTIME_TIMESTAMP=str(us), _PID="11", _EXE="/usr/bin/python3",
               _CMDLINE="python3 x.py --token s3cret"),
        record(__CURSOR="c4", __REALTIME_TIMESTAMP="later", _PID="12", _EXE="/tmp/x"),
        "not json", record(__CURSOR="c5", __REALTIME_TIMESTAMP=str(us), _PID="13"), ""]
    path = put(tmp_path, "journal.json", "\n".join(lines))
    rows = {r["executable"]: r for r in LX.read_journal(spark, path, window=WINDOW,
                                                        include_command_lines=True).collect()}
    assert set(rows) == {"/usr/sbin/cron", "/usr/bin/python3"}
    cron = rows["/usr/sbin/cron"]
    assert cron["extra"]["journal_record_count"] == "2" and cron["source_record_id"] == "c2"
    assert (cron["last_seen"] - cron["ts"]).seconds == 60 and cron["execution_confirmed"]
    assert rows["/usr/bin/python3"]["command_line"] == "python3 x.py --token [redacted]"
    assert "command_line_secrets" in rows["/usr/bin/python3"]["unavailable"]
    quiet = LX.read_journal(spark, path, window=WINDOW).filter("pid = 11").collect()[0]
    assert quiet["command_line"] is None and "command_line" in quiet["unavailable"]
    assert quiet["command_reconstruction_status"] == "EXECUTABLE_ONLY"
    from traceloom.sources.lines import read_lines
    status = LX.journal_status(read_lines(spark, path, numbered=False)).collect()[0]
    assert (status["scanned"], status["malformed"]) == (6, 2)


def test_shell_history(spark, tmp_path):
    stamped = f"#{EPOCH}\nmysql --password=hunter2\nplain one\n\n#{EPOCH + 5}\n\n#{EPOCH + 9}\nlast cmd\n"
    put(tmp_path, "home/u/dot_bash_history", stamped)
    put(tmp_path, "home/u/dot_zsh_history", f": {EPOCH}:0;export API_KEY=zzz\n: 100:0;too old\n", host="h2")
    rows = {r["source_record_id"]: r for r in LX.read_shell_history(
        spark, str(tmp_path), window=WINDOW).collect()}
    first = rows["/home/u/.bash_history:2"]
    assert first["full_command_line"] == "mysql --password=[redacted]" and first["ts"] is not None
    assert first["evidence_kind"] == "COMMAND_HISTORY" and not first["execution_confirmed"]
    assert rows["/home/u/.bash_history:3"]["ts"] is None
    assert rows["/home/u/.bash_history:8"]["ts"].second == 9
    zsh = rows["/home/u/.zsh_history:1"]
    assert zsh["full_command_line"] == "export API_KEY=[redacted]" and zsh["interpreter"] == "zsh"
    assert len(rows) == 4


def test_stamps_cross_slices(spark):
    from traceloom.sources import lines as LN
    rows = []
    for n in range(1, 41):
        rows.append(("h", "/f", n, f"#{EPOCH + n}" if n % 2 else f"cmd{n}"))
    df = spark.createDataFrame(rows, "endpoint_id string, file string, line_no bigint, value string")
    keep = LN.sliced
    LX.sliced = lambda d, g: keep(d, g, size=3)
    try:
        got = {r["full_command_line"]: r["ts"].second for r in LX.parse_shell_history(df).collect()}
    finally:
        LX.sliced = keep
    assert got == {f"cmd{n}": (n - 1) for n in range(2, 41, 2)}


def test_large_file_line_numbers(spark, tmp_path):
    from traceloom.sources.lines import read_lines
    path = put(tmp_path, "big.log", "\n".join(f"line {n}" for n in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_lines(spark, path)
        assert rows.filter("value <> concat('line ', line_no)").count() == 0 and rows.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_audit_and_accounting(spark, tmp_path):
    good = 'type=SYSCALL msg=audit({}.1:{}): arch=c ppid=1 pid=22 uid=1000 comm="curl" exe="/usr/bin/curl"'
    text = "\n".join([good.format(EPOCH, 7), good.format(99, 8), good.format("bad", 9),
                      f"type=PATH msg=audit({EPOCH}.1:9): exe=\"/x\""])
    path = put(tmp_path / "a", "audit.log", text)
    rows = LX.read_audit_execve(spark, path, window=WINDOW).collect()
    assert [(r["pid"], r["parent_pid"], r["user"], r["source_record_id"]) for r in rows] == [
        (22, 1, "1000", "audit:7")]
    path = put(tmp_path / "b", "pacct.txt", "bash  S  root pts/0 0.01 secs\nshort row\n")
    rows = LX.read_process_accounting(spark, path).collect()
    assert [(r["process_name"], r["user"], r["source_record_id"], r["ts"]) for r in rows] == [
        ("bash", "root", "pacct:0", None)]


def test_login_sessions(spark, tmp_path):
    def entry(kind, user, seconds):
        return struct.pack("<hxxi32s4s32s256shhiii4i20x", kind, 42, b"pts/0", b"0", user, b"10.0.0.9", 0, 0,
                           1, seconds, 0, 0, 0, 0, 0)
    put(tmp_path, "wtmp", entry(7, b"ann", EPOCH) + entry(9, b"bob", EPOCH) + entry(8, b"", EPOCH)
        + entry(8, b"ann", 5))
    put(tmp_path, "wtmp", entry(7, b"eve", EPOCH) + b"x", host="h2")
    rows = LX.read_login_sessions(spark, str(tmp_path), window=WINDOW).collect()
    assert [(r["endpoint_id"], r["user"], r["process_name"], r["pid"], r["source_record_id"]) for r in rows] == [
        ("h1", "ann", "session_open", 42, "wtmp:0")]
    assert rows[0]["extra"] == {"session_line": "pts/0", "session_host": "10.0.0.9"}


def test_windows_xml_files(spark, tmp_path):
    def event(number, record_id, data):
        rows = "".join(f'<Data Name="{k}">{v}</Data>' for k, v in data.items())
        return (f'<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>{number}'
                f'</EventID><TimeCreated SystemTime="2024-01-02T03:04:05.1234567Z"/><EventRecordID>{record_id}'
                f'</EventRecordID></System><EventData>{rows}</EventData></Event>')
    text = "\n".join([
        event(4688, 1, {"NewProcessName": "C:\\Windows\\a.exe", "NewProcessId": "0x4d2", "ProcessId": "0x10",
                        "SubjectUserName": "ann", "SubjectDomainName": "CORP"}),
        event(4688, 2, {"NewProcessName": "C:\\b.exe", "CommandLine": "b --token abc"}),
        event(1, 3, {"Image": "C:\\p\\powershell.exe", "CommandLine": "powershell -enc AAA",
                     "UtcTime": "2024-01-02 03:04:06.500", "Hashes": "MD5=1,SHA256=" + "AB" * 32}),
        event(4104, 4, {"ScriptBlockText": "x" * 5000, "MessageNumber": "2"})])
    path = put(tmp_path, "security.xml", text)
    records = WN.read_event_xml(spark, path)
    rows = {r["source_record_id"]: r for r in WN.parse_process_creation(
        records, include_command_lines=True).collect()}
    assert rows["1"]["pid"] == 1234 and rows["1"]["user"] == "CORP\\ann"
    assert rows["1"]["unavailable"]["command_line"] == "the host does not log command lines"
    assert rows["2"]["command_line"] == "b --token [redacted]"
    sysmon = WN.parse_sysmon(records, include_command_lines=True).collect()[0]
    assert sysmon["hash"] == "ab" * 32 and sysmon["ts"].second == 6 and sysmon["interpreter"] == "powershell.exe"
    assert len(WN.parse_powershell_blocks(records).collect()[0]["command_line"]) == 5000
    block = WN.parse_powershell_blocks(records, text_limit=4000).collect()[0]
    assert len(block["command_line"]) == 4000 and block["command_reconstruction_status"] == "PARTIAL"


def test_windows_records_are_parsed_once(spark):
    rows = spark.range(4).selectExpr("'h' AS endpoint_id", "concat('<Event><System><EventID>4104</EventID></System><EventData>"
                                     "<Data Name=\"ScriptBlockText\"> a -token ', id, ' b </Data></EventData></Event>') AS xml")
    blocks = WN.parse_powershell_blocks(WN.parse_event_xml(rows))
    plan = blocks.select("command_line", "command_reconstruction_status")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1                 # neither the filter nor a field parses the record again
    assert sorted(r["command_line"] for r in blocks.collect()) == ["a -token [redacted] b"] * 4


def test_userassist_and_prefetch(spark):
    ticks = (EPOCH + 11644473600) * 10_000_000
    value = bytearray(72)
    struct.pack_into("<I", value, 4, 3)
    struct.pack_into("<Q", value, 60, ticks)
    df = spark.createDataFrame([("h", "{g}", "P:\\Gbbyf\\k.rkr", value), ("h", "{g}", "n", bytearray(10))],
                               "endpoint_id string, guid string, name string, value binary")
    rows = WN.parse_userassist(df, window=WINDOW).collect()
    assert [(r["executable"], r["process_name"], r["extra"]["run_count"]) for r in rows] == [
        ("C:\\Tools\\x.exe", "x.exe", "3")]
    files = spark.createDataFrame([("h", "/P/A.EXE-1F2E.pf", "A.EXE-1F2E.pf", WINDOW[0], 5),
                                   ("h", "/P/x.db", "x.db", WINDOW[0], 5)],
                                  "endpoint_id string, path string, name string, modified timestamp, size_bytes bigint")
    assert [r["process_name"] for r in WN.parse_prefetch_listing(files).collect()] == ["A.EXE"]


def test_usb_lines(spark):
    messages = ["usb 1-1: new high-speed USB device number 5 using xhci", "usb 1-1: New USB device found, idVendor=0781, idProduct=5567, bcd",
                "usb 1-1: Product: Cruzer", "usb 1-1: SerialNumber: 4C53", "usb 1-1: USB disconnect, device number 5",
                "usb 1-1: Product: stray"]
    rows = [("h", n, json.dumps({"MESSAGE": m, "__REALTIME_TIMESTAMP": str((EPOCH + n) * 10**6)}))
            for n, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "endpoint_id string, line_no bigint, value string")
    got = HO.usb_events(df).orderBy("event_line").collect()
    assert [(r["action"], r["product"], r["serial"]) for r in got] == [
        ("connected", "Cruzer", "4C53"), ("disconnected", None, None)]


def test_packages_from_files(spark, tmp_path):
    put(tmp_path / "l", "var/lib/dpkg/info/curl%3Aamd64.list", "/.\n/usr/bin//curl\n")
    put(tmp_path / "l", "var/lib/dpkg/info/zz.list", "/usr/bin/curl\n")
    rows = RT.read_package_ownership(spark, str(tmp_path / "l")).collect()
    assert [(r["path"], r["package"]) for r in rows] == [("/usr/bin/curl", "curl")]
    put(tmp_path / "s", "status", "Package: curl\nVersion: 8.5\nDescription: fetch\n more\n\nPackage: zz\n")
    rows = {r["package"]: r for r in RT.read_package_status(spark, str(tmp_path / "s")).collect()}
    assert rows["curl"]["version"] == "8.5" and rows["curl"]["description"] == "fetch" and "zz" in rows


def test_ledger_documents(spark):
    import pytest
    good = {"/a": [{"algorithm": "SHA256", "hash": "a" * 64, "size_bytes": 1,
                    "timestamp": "2024-01-01T00:00:00+00:00"}]}
    bad = {"/b": [{"algorithm": "SHA256", "hash": "zz", "size_bytes": 1, "timestamp": "x"}], **good}
    docs = spark.createDataFrame([("h1", json.dumps(good)), ("h2", json.dumps(bad))],
                                 "endpoint_id string, value string")
    assert [r["endpoint_id"] for r in RT.hash_ledger(docs, strict=False).collect()] == ["h1"]
    assert RT.ledger_rejects(docs).collect()[0]["endpoint_id"] == "h2"
    with pytest.raises(Exception):
        RT.hash_ledger(docs).collect()


def test_files_and_digests(spark, tmp_path):
    path = put(tmp_path, "home/u/a.pdf", b"%PDF-1.4 x %%EOF")
    row = HO.file_digests(spark, path).collect()[0]
    import hashlib
    assert row["hash"] == hashlib.sha256(b"%PDF-1.4 x %%EOF").hexdigest()
    assert row["integrity"]["status"] == "ok" and row["container"] == "raw"
    inv = HO.file_inventory(HO.read_file_inventory(spark, path)).collect()[0]
    assert (inv["endpoint_id"], inv["path"], inv["name"]) == ("h1", "/home/u/a.pdf", "a.pdf")


def test_fixed_records_of_large_files(spark, tmp_path):
    """Many tasks of one file, in any cut; files of odd size are left out, as are other names."""
    rng = random.Random(1)
    contents = {"a/wtmp": rng.randbytes(384 * 1000), "b/wtmp": rng.randbytes(384 * 7), "b/odd": b"x" * 385, "c/none": b"",
                "c/wtmp.txt": rng.randbytes(384)}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = {(name, at): data[at:at + 384] for name, data in contents.items() if len(data) % 384 == 0
            for at in range(0, len(data), 384)}
    for split in (384, 40_000, 1 << 26):
        rows = RG.read_fixed_records(spark, str(tmp_path), 384, split=split)
        assert {(str(r["path"])[len(str(tmp_path)) + 1:], r["offset"]): bytes(r["rec"]) for r in rows.collect()} == want
        assert rows.rdd.getNumPartitions() >= min(1000, 384_000 // split)
    assert RG.read_fixed_records(spark, str(tmp_path / "b"), 384, pattern="wtmp").count() == 7
    assert RG.read_fixed_records(spark, f"file://{tmp_path}/none", 384).count() == 0
    with open(tmp_path / "a" / "huge", "wb") as file:
        file.truncate(384 * 9_000_000)                                  # 3.4 GB that take no room
    tasks = RG._RecordReader({"path": str(tmp_path / "a"), "pattern": "huge", "record": "384"}).partitions()
    assert len(tasks) > 50 and sum(r[2] for t in tasks for r in t.ranges) == 384 * 9_000_000
    last = RG._RecordReader({"path": str(tmp_path / "a"), "record": "384"}).read(tasks[-1])
    assert sum(b.num_rows for b in last) == tasks[-1].ranges[0][2] // 384


def test_file_digests_in_blocks(spark, tmp_path):
    rng = random.Random(2)
    contents = {"x": b"", "d/y": b"abc", "d/e/z": rng.randbytes((8 << 20) * 2 + 17), "big": bytes((2 << 30) + 5)}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        if name == "big":
            with open(tmp_path / name, "wb") as file:
                file.truncate(len(data))                                # above what one row can hold
        else:
            (tmp_path / name).write_bytes(data)
    rows = RG.read_file_digests(spark, str(tmp_path), split=1000).collect()
    assert {str(r["path"])[len(str(tmp_path)) + 1:]: (r["bytes"], r["sha256"]) for r in rows} == {
        n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    few = RG.read_file_digests(spark, str(tmp_path / "d"), algorithms=("md5", "sha1", "sha512")).collect()
    content = spark.createDataFrame([(contents["d/y"],)], "c binary").select(
        *[X.content_digest("c", a) for a in ("MD5", "SHA1", "SHA512")]).collect()[0]
    assert tuple(content) in {(r["md5"], r["sha1"], r["sha512"]) for r in few} and len(few) == 2
    with pytest.raises(Exception, match="algorithms must be of"):
        RG.read_file_digests(spark, str(tmp_path), algorithms=("crc32",)).count()
