"""From queries to packages: retrieval, screening, filling and rendering, for many queries in one job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import BUDGET, RETRIEVAL, Budget, Retrieval
from lodestone.operators import graph, packing, security, tree
from lodestone.plans.retrieve import Corpus, explained, retrieve
from lodestone.sources.shared import written

NO_SYMBOLS = "array<struct<id:string,kind:string,start_line:int,end_line:int,signature:string>>"


def packages(spark: SparkSession, corpus: Corpus, queries: DataFrame, texts: DataFrame, budget: Budget = BUDGET, cfg: Retrieval = RETRIEVAL, policy: str = "warn", redacting: bool = True, symbols: DataFrame | None = None, pins: DataFrame | None = None, hints: DataFrame | None = None, project: str = "project", version: str = "") -> DataFrame:
    """query_id, payload, files (in order), chars, lines, tokens, findings. texts: path, text; symbols: path, id, kind,
    start_line, end_line, signature. Every payload holds its budget and passes the leak gate, else the job fails."""
    signals, ranking = retrieve(corpus, queries, cfg, hints=hints, pins=pins)
    ranked = written(explained(signals, ranking), "ranked")
    pinned = F.lit(False) if pins is None else F.col("pin").isNotNull()
    if pins is not None:
        ranked = ranked.join(pins.select("query_id", "path", F.lit(1).alias("pin")).distinct(), ["query_id", "path"], "left")
    ranked = packing.packing_order(ranked.withColumn("pinned", pinned).withColumn("tier", packing.tier(F.col("kinds"), pinned)))
    # Every candidate is read once; what is screened here is what is packed.
    snapshot = written(texts.join(ranked.select("path").distinct(), "path", "left_semi").select("path", "text"), "snapshot")
    found = written(security.find(snapshot), "findings")
    verdict = security.verdicts(snapshot, found, policy, redacting)
    safe = snapshot
    if policy == "warn" and redacting:
        safe = security.redact(snapshot, security.merge_spans(found.select("path", "start", "end", "kind")))
    open_ = safe.join(verdict.filter("action <> 'blocked'").select("path"), "path", "left_semi")
    own = F.lit(None).cast(NO_SYMBOLS)
    cand = ranked.join(open_, "path", "left").select("query_id", "ord", "path", "text", "score", "tier", "reasons")
    if symbols is not None:
        s = symbols.groupBy("path").agg(F.collect_list(F.struct("id", "kind", "start_line", "end_line", "signature")).alias("symbols"))
        cand = cand.join(s, "path", "left")
    else:
        cand = cand.withColumn("symbols", own)
    lines = [r["line"] for r in tree.tree_lines(corpus.entries.select("path"), budget.tree_depth, budget.tree_entries).orderBy("ord").collect()]
    folders = [tuple(r) for r in tree.top_folders(corpus.entries.select("path")).collect()]
    hubs, packs = [], []
    if corpus.edges is not None:
        files = corpus.entries.select("path", F.lit(False).alias("is_test"))
        hubs = [tuple(r) for r in graph.hubs(corpus.edges, files, 8).collect()]
        packs = [r[0] for r in tree.external_packages(corpus.edges).collect()]
    skeleton = packing.render(project, version, "", lines, folders, hubs, packs, [], [], [], 10, 0, budget)
    packed = written(packing.pack(cand, budget, skeleton), "packed")
    why = packing.why_rows(cand, packed, verdict)
    ordered = why.join(packed.select("query_id", "path", "ord", "section", "level"), ["query_id", "path"], "left").withColumn("place", F.coalesce("ord", F.lit(1 << 20)))
    leaky = security.gated(found).groupBy("path").agg(F.collect_list(F.struct("kind", "path", "line", "match", "confidence")).alias("secrets"), F.count("*").alias("n_secrets"))
    rows = queries.select("query_id", F.col("text").alias("task")).join(ordered.join(leaky, "path", "left"), "query_id", "left")
    kind = dict(queries.dtypes)["query_id"]

    def render(batches: pd.DataFrame) -> pd.DataFrame:
        d = batches.sort_values(["place", "path"])
        task, qid = d["task"].iloc[0] or "", d["query_id"].iloc[0]
        d = d[d["path"].notna()]
        flags = list(zip(d["path"], d["tier_label"], d["score"], d["reasons"], d["included"], d["note"], strict=True))
        secrets = [dict(s) if isinstance(s, dict) else s.asDict() for group in d["secrets"] if group is not None for s in group]
        sections = [{"path": p, "level": lv, "section": s} for p, lv, s, inc in zip(d["path"], d["level"], d["section"], d["included"], strict=True) if inc and s]

        def whole(kept: list[dict]) -> str:
            shown = {s["path"] for s in kept}
            why_ = [{"path": p, "tier_label": t, "score": x, "reasons": list(r), "included": p in shown, "note": n} for p, t, x, r, _, n in flags]
            return packing.settle_tokens(lambda n: packing.render(project, version, task, lines, folders, hubs, packs, [], why_, kept, n, len(secrets), budget))[0]

        text, kept = packing.degrade(sections, whole, budget)
        if policy != "block" or secrets:
            security.leak_gate(secrets, text)
        return pd.DataFrame([[qid, text, [s["path"] for s in kept], len(text), packing.count_payload_lines(text), -(-len(text) // 4), len(secrets)]], columns=["query_id", "payload", "files", "chars", "lines", "tokens", "findings"])

    return rows.groupBy("query_id").applyInPandas(render, f"query_id {kind}, payload string, files array<string>, chars long, lines long, tokens long, findings long")


def write_payloads(payloads: DataFrame, path: str) -> None:
    """One text file tree by query; a row is one payload."""
    payloads.select("query_id", F.col("payload").alias("value")).write.partitionBy("query_id").option("lineSep", "\n").text(path)


def payload_stream(payloads: DataFrame) -> Iterator[str]:
    """Payloads one after the other, for a caller that shows them."""
    for row in payloads.select("payload").toLocalIterator():
        yield row[0]
