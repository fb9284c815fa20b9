"""The whole analysis of a set of collected tables, as :func:`traceloom.sinks.write_evidence_tables` stores it.

Scored events, numbers and components are written on the way; what is returned are tables over these.
"""

from pyspark.sql import DataFrame, functions as F

from . import vocab as V
from .operators import activity as A
from .operators import correlate as C
from .operators import cross_source as S
from .operators import events as E
from .operators import findings as R
from .operators import narrative as N
from .operators import recognize as G
from .operators import threads as H
from .operators import timeline as M
from .operators.scoring import classify_events
from .session import checkpoint


def run_pipeline(inputs: dict[str, DataFrame], *, with_threads=True,
                 recognition: dict | None = None) -> dict[str, DataFrame]:
    """Tables by name from ``events``, ``artifacts`` and, when present, ``downloads``,
    ``mounts``, ``usb_events``, ``drivers`` (verified), ``processes``, ``transitions``, ``memory`` and
    ``memory_images``, ``sources`` (what could be read) and ``flags`` (what was cut short).

    ``recognition`` holds the reference tables :func:`recognize` takes. With ``sources`` the case summary is told.
    """
    events = E.assign_event_references(E.dedupe_events(inputs["events"]))
    artifacts = E.assign_artifact_references(inputs["artifacts"])
    if recognition:
        named = events.filter("executable IS NOT NULL").select(
            "endpoint_id", events["executable"].alias("path"))
        known = G.recognize(named.unionByName(artifacts.select("endpoint_id", "path")),
                            **recognition)
        events = G.attach_recognition(events, known)
        artifacts = G.attach_recognition(artifacts, known, "path")
    # Scoring feeds several tables; it is written once rather than run once per table.
    classified = checkpoint(classify_events(events, artifacts))
    groups = A.rank_groups(A.activity_groups(classified))
    records = A.activity_records(classified)
    rules = [C.artifact_findings(events, artifacts), C.indicator_findings(artifacts)]
    if {"history_status", "integrity_status"} <= set(artifacts.columns):
        rules.append(C.integrity_findings(artifacts))
    later = []
    if "drivers" in inputs:
        later.append(C.driver_findings(inputs["drivers"]))
    if "downloads" in inputs:
        later.append(S.download_findings(S.link_downloads(inputs["downloads"], artifacts, events)))
    if "mounts" in inputs:
        later.append(S.removable_media_findings(inputs["mounts"], events, artifacts,
                                                inputs.get("usb_events")))
    if {"memory", "memory_images"} <= set(inputs):
        later.append(C.memory_findings(inputs["memory"], inputs["memory_images"]))
    findings = R.all_findings(C.union_sources(*rules), *later)
    gaps = []
    if "sources" in inputs:
        gaps.append(C.telemetry_limitations(inputs["sources"]))
    if "flags" in inputs:
        gaps.append(C.completeness_limitations(inputs["flags"], events, artifacts))
    limitations = C.union_sources(*gaps) if gaps else findings.limit(0).drop("reference")
    leads = A.leads(groups)
    out = {"events": A.with_group_triage(classified, groups), "artifacts": artifacts, "activity": groups,
           "activity_records": records, "leads": leads, "findings": findings, "limitations": limitations,
           "finding_evidence": R.finding_evidence(findings),
           "links": C.link_events_artifacts(events, artifacts)}
    if "modified" in artifacts.columns:
        out["timeline"] = M.build_timeline(classified.drop("classification"), artifacts,
                                           inputs.get("processes"), findings,
                                           inputs.get("transitions"))
    if with_threads:
        out["threads"], out["thread_members"] = H.threads(groups, records, max_df=V.TOKEN_MAX_DF)
    if "modified" in artifacts.columns:
        out["significant_events"] = M.significant_events(groups, findings, artifacts, inputs.get("transitions"))
    if recognition:
        out["recognized_software"] = G.recognized_software(artifacts)
    if "sources" in inputs:
        counts = N.record_counts(groups, artifacts, findings, limitations, leads)
        kinds = ["investigation_id", "evidence_kind", "priority", "pattern"]
        cited = A.lead_references(groups, records).join(leads.select(*kinds, "lead_id"), kinds).select(
            "investigation_id", "priority", "lead_id", F.col("reference").alias("id"))
        out["record_counts"] = counts
        out["conclusion"] = N.conclusion(counts, inputs["sources"])
        out["case_summary"] = N.case_summary(
            counts, inputs["sources"], leads, cited, findings, limitations, threads=out.get("threads"),
            recognized=artifacts if recognition else None)
    return out
