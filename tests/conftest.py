import os
import sys

import pytest

from core_samples import at

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from traceloom.session import build_session
    session = build_session(
        "traceloom-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
           "spark.sql.streaming.schemaInference": "true",
           "spark.sql.streaming.noDataMicroBatches.enabled": "true",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


EVENT = ("investigation_id string, endpoint_id string, event_id string, ts timestamp, source string,"
         "evidence_kind string, execution_confirmed boolean, full_command_line string,"
         "normalized_command string, executable string, process_name string,"
         "source_record_id string, user string, systemd_unit string, pid bigint,"
         "command_reconstruction_status string, command_evidence_strength string,"
         "unavailable map<string,string>, reference string")
ARTIFACT = ("investigation_id string, endpoint_id string, collection_order bigint, path string,"
            "filename string, collection_status string, hash string, hash_algorithm string,"
            "size_bytes bigint, source string, reference string")


@pytest.fixture
def make_events(spark):
    def make(rows):
        full = []
        for number, row in enumerate(rows):
            command, image = row.get("command"), row.get("image")
            full.append((
                row.get("inv", "i"), row.get("host", "h"), row.get("id", f"e{number:05d}"),
                at(row.get("ts")), row.get("source", "bash history"),
                row.get("kind", "COMMAND_HISTORY"), row.get("ran", False), command,
                (command or "").lower() or None, image,
                row.get("name") or (image or command or "x").split()[0].split("/")[-1],
                row.get("record", f"r{number}"), row.get("user"), row.get("unit"), None,
                "EXACT" if command else "EXECUTABLE_ONLY" if image else "NOT_AVAILABLE", None,
                row.get("gaps", {}), row.get("ref", f"EV-{number:04d}")))
        return spark.createDataFrame(full, EVENT)
    return make


@pytest.fixture
def make_artifacts(spark):
    def make(rows):
        full = [(r.get("inv", "i"), r.get("host", "h"), n, r["path"],
                 r["path"].replace("\\", "/").split("/")[-1], r.get("status", "COLLECTED"),
                 r.get("hash", "aa" if r.get("status", "COLLECTED") == "COLLECTED" else None),
                 "SHA256", 10, "selected path", f"ART-{n + 1:04d}") for n, r in enumerate(rows)]
        return spark.createDataFrame(full, ARTIFACT)
    return make
