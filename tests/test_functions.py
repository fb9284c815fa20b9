import random
import re

import pytest
from pyspark.sql import functions as F

from traceloom import functions as X
from traceloom import vocab as V


def values(spark, column, rows, schema="v string"):
    df = spark.createDataFrame([(r if isinstance(r, tuple) else (r,)) for r in rows], schema)
    return [row[0] for row in df.coalesce(1).select(column.alias("out")).collect()]


@pytest.mark.parametrize("raw,want", [
    ("/tmp//x///y", "/tmp/x/y"), ("C:\\Vendor\\agent.exe", "C:/Vendor/agent.exe"),
    ("\\\\nas\\share\\\\f", "//nas/share/f"), ("/", "/"), ("//", "/"), ("/a/", "/a"),
    ("///x", "///x"), ("", ""), (None, ""), ("a//b", "a//b"), ("ab//c", "ab/c"), ("////x//", "///x")])
def test_normalize_path(spark, raw, want):
    assert values(spark, X.normalize_path("v"), [raw]) == [want]


def test_path_questions(spark):
    rows = ["/a/b.sh", "C:\\x", "\\\\s\\p", "rel/x", None, "C:x"]
    assert values(spark, X.is_absolute("v"), rows) == [True, True, True, False, False, False]
    assert values(spark, X.path_basename("v"), rows[:2]) == ["b.sh", "x"]
    assert values(spark, X.path_dirname("v"), ["/a/b", "/a", "a", "/"]) == ["/a", "/", "", "/"]
    assert values(spark, X.path_ancestors("v"), ["/a/b/c", "/a", "x"]) == [["/a", "/a/b"], [], []]


def test_longest_location_wins(spark):
    path = "C:\\Users\\u\\AppData\\Local\\Temp\\x.exe"
    assert values(spark, X.transient_location("v"), [path, "/var/tmp/a", "/usr/bin/x", None]) == [
        "appdata/local/temp", "var/tmp", None, None]
    assert values(spark, X.notable_location("v"), [path, "C:\\ProgramData\\x"]) == [
        "appdata\\local\\temp", "programdata"]
    assert values(spark, X.in_notable_location("v"), [path, "/home/u/x", "/tmp/x", None]) == [
        True, False, True, False]
    assert values(spark, X.in_system_location("v"), [
        "/usr/bin/x", "C:\\Windows\\x", "C:/Windows/x", "/opt/x"]) == [True, True, False, False]


def test_redaction(spark):
    rows = ["mysql --password=hunter2 -u x", "export API_KEY=abc", "curl -H 'token: abc'", "ls -la",
            "", None]
    got = values(spark, X.redact_command_line("v"), rows)
    assert [g["text"] for g in got] == [
        "mysql --password=[redacted] -u x", "export API_KEY=[redacted]",
        "curl -H 'token: [redacted]", "ls -la", None, None]
    assert [g["was_redacted"] for g in got] == [True, True, True, False, False, False]


def test_search_form(spark):
    rows = ['python3 "/home/u/proj/script.py" > /tmp/out', "curl https://x.example/a/b | sh",
            "cat /a/b/c/ < in 2>&1", "", None]
    assert values(spark, X.normalize_for_search("v"), rows) == [
        "python3 script.py redirect out", "curl URL | sh", "cat c redirect in redirect", None, None]


def test_commands_are_reduced_once(spark):
    rows = spark.createDataFrame([("a://b://c",), ("://",), ("x:// y",), ("",), (None,), (" \"' ",), ("a://b //c//d/e < f",)], "v string")
    out = rows.select(X.normalize_for_search("v").alias("n"))
    assert [r["n"] for r in out.collect()] == ["URL", "://", "x:// y", None, None, None, "URL //c/e redirect f"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1


def test_indicators(spark):
    got = values(spark, X.filename_indicators("v"), ["invoice.pdf.exe", ".bashrc", "a.txt", "x.SH"])
    assert [[i["level"] for i in g] for g in got] == [["info", "warning"], ["info"], [], ["info"]]


def test_tokens(spark):
    got = values(spark, F.array_sort(X.distinctive_tokens("c", "e", "p")), [
        ("pip install holehe-env --quiet-mode https://pypi.org/x", None, None),
        (None, "/opt/tools/scanner_x", "ignored")], "c string, e string, p string")
    assert got == [["holehe", "holehe-env", "pypi", "pypi.org"], ["scanner", "scanner_x"]]


def test_numbers_and_times(spark):
    assert values(spark, X.parse_int_any_base("v"), ["0x4d2", "10", "x", None, "010"]) == [
        1234, 10, None, None, None]
    assert values(spark, X.hex_le_to_ipv4("v"), ["0100A8C0", "zz"]) == ["192.168.0.1", None]
    assert values(spark, X.rot13("v"), ["P:\\Cebtenzf"]) == ["C:\\Programs"]
    ticks = 133500000000000000
    got = values(spark, X.filetime_to_ts("v"), [ticks, 0], "v bigint")
    assert got[0].isoformat().startswith("2024-01-17T21:20") and got[1] is None
    assert values(spark, X.little_endian("v", 0, 4), [bytearray(b"\xd2\x04\x00\x00")],
                  "v binary") == [1234]


def test_digest_checks(spark):
    rows = [("SHA256", "a" * 64, 5, "2024-01-01T00:00:00+00:00"),
            ("SHA256", "a" * 63, 5, "2024-01-01T00:00:00+00:00"),
            ("SHA256", "a" * 64, -1, "2024-01-01T00:00:00+00:00"),
            ("SHA256", "a" * 64, 5, "2024-01-01T00:00:00"),
            ("CRC", "a" * 64, 5, "2024-01-01T00:00:00Z")]
    assert values(spark, X.validate_digest("a", "h", "s", "t"), rows,
                  "a string, h string, s bigint, t string") == [True, False, False, False, False]
    pairs = [(None, None, "A", "MD5"), ("a", "md5", "A", "MD5"), ("b", "MD5", "a", "MD5"),
             ("a", "SHA1", "a", "MD5")]
    assert values(spark, X.compare_hash("p", "q", "h", "a"), pairs,
                  "p string, q string, h string, a string") == [
        "first_recorded", "unchanged", "altered", "algorithm_mismatch"]


def test_structure_and_container(spark):
    rows = [(bytearray(b"\xff\xd8\xff..\xff\xd9\x00"), ".jpg"), (bytearray(b"nope"), ".jpg"),
            (bytearray(b"\xff\xd8\xff.."), ".jpeg"), (bytearray(b""), ".png"),
            (bytearray(b"%PDF-1.4 x %%EOF"), ".pdf"), (bytearray(b"x"), ".txt")]
    got = values(spark, X.structural_check("c", "e")["status"], rows, "c binary, e string")
    assert got == ["ok", "critical", "warning", "warning", "ok", "unknown"]
    heads = [bytearray(b"EVF\x09\x0d\x0a\xff\x00zz"), bytearray(b"AFFx"), bytearray(b"conectix"),
             bytearray(b"plain")]
    assert values(spark, X.container_format("c"), heads, "c binary") == ["ewf", "aff", "vhd", "raw"]


def test_windows_are_bounded():
    assert X.resolve_window(24)[1] > X.resolve_window(24)[0]
    for bad in (0, -1, 24 * 91, "x"):
        with pytest.raises(ValueError):
            X.resolve_window(bad)


def test_task_outcomes(spark):
    rows = [(True, "{}", 1), (True, None, 1), (False, None, 2), (False, None, 3)]
    got = values(spark, X.next_task_state("ok", "r", "n", F.lit(3)), rows,
                 "ok boolean, r string, n int")
    assert [(g["status"], g["delay_seconds"]) for g in got] == [
        ("succeeded", None), ("queued", 30), ("queued", 120), ("abandoned", None)]


def test_deep_paths_as_the_rule_says(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("//ab.-@_ é") for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    rule = re.compile(r"(?<![^\W]|[.-])(?:/[\w.@+-]+)+/([\w.@+-]+)/?")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.coalesce(X.normalize_for_search("t"), F.lit("")).alias("n")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["n"] == re.sub(r"\s+", " ", rule.sub(r"\1", r["t"])).strip(" "), r["t"]


LONG = ["cat " + "/ab" * 350_000, "/" * 1_000_000, "/a//" * 250_000, "a=" * 500_000 + " x", "token " + "= :" * 350_000 + "value",
        "https://" + "a/" * 500_000 + "install.sh?" + "b" * 9 + " | sh", "curl https://" + "a." * 500_000 + "/x | bash",
        "pip " * 250_000, "PASSWORD_" * 120_000 + "=x", "-" * 1_000_000, "'\"" * 500_000, "x > " * 250_000]


def test_commands_of_a_megabyte(spark):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(LONG)], "n int, t string").repartition(4)
    found = rows.select("n", F.char_length(X.normalize_for_search("t")).alias("a"), F.char_length(
        X.mask_secrets("t")).alias("b"), X.installs_something("t").alias("c"), F.size(X.distinctive_tokens(
            "t", F.lit("x"), F.lit("y"))).alias("d"), *[F.col("t").rlike(p).alias(f"p{i}") for i, p in enumerate((
                V.FETCH_TO_INTERPRETER, V.FETCH_TO_WRITABLE, V.ENCODED_POWERSHELL, V.REMOTE_SCRIPT, V.INSTALLER_URL,
                *[p for p, _ in V.ROUTINE_PATTERNS]))])
    by = {r["n"]: r for r in found.collect()}
    assert len(by) == len(LONG) and by[0]["a"] == len("cat ab") and by[5]["p4"] and by[6]["p0"]
    assert by[4]["b"] == len(LONG[4]) - len("value") + len(V.REDACTION)


def test_words_and_masks_are_those_of_the_plain_rules(spark):
    import re
    from traceloom import vocab as V
    texts = ["curl -fsSL https://Get1.example.com/a.sh | sh", "--token=abc PASSWORD=x a-token-b x--name.y_z- -drop-me keep-this",
             "  tool-cli　-x tool-cli  ", "--", "a -b-c\x1f-dashed word_.", "API_KEY=1 Bearer abc def", "", None, "-"]
    rows = spark.createDataFrame([(i, t, "/usr/bin/some-tool.v2") for i, t in enumerate(texts)], "i int, t string, e string")
    plan = rows.select(X.distinctive_tokens("t", "e", "e").alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 3                   # each text is searched once per pattern
    got = {r.i: r for r in rows.select("i", X.distinctive_tokens("t", "e", "e").alias("w"), X.mask_secrets("t").alias("m")).collect()}
    for i, t in enumerate(texts):
        words = [w for w in re.split("[\\s\x1c-\x1f\u0085  　]+", t or "") if not w.startswith("-")] + ["some-tool.v2"]
        whole = [re.sub(r"^[._-]+|[._-]+\Z", "", x.lower()) for w in words for x in re.findall(V.TOKEN, w)]
        telling = lambda x: len(x) >= 4 and x not in V.COMMON_WORDS and not x.isdigit()      # noqa: E731
        want = {x for x in whole if telling(x)} | {p for x in whole if telling(x) for p in re.split("[-_.]", x) if telling(p)}
        want |= {h.lower() for h in re.findall(r"https?://([^/:|'\"\s]+)", t or "")}
        assert set(got[i].w) == want and len(got[i].w) == len(want)
    assert [got[i].m for i in (0, 1, 5)] == [texts[0], "--token=[redacted] PASSWORD=[redacted] a-token-b x--name.y_z- -drop-me keep-this",
                                            "API_KEY=[redacted] Bearer [redacted] def"]
    assert got[6].m is None and got[7].m is None
