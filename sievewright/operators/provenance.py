"""Provenance: generator guesses, marker scans, agent markers, keyed watermark tests, perplexity aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import catalogue
from sievewright.functions.columns import band, clamp, hits, total

# Marker lists.
DIRECT_TOOLS = (
    ("Midjourney/Niji 추정", ("midjourney", "niji")),
    ("Flux / Black Forest Labs 추정", ("flux", "black forest labs", "bfl")),
    ("Stable Diffusion 추정", ("stable diffusion", "stablediffusion", "automatic1111", "a1111", "sd-webui")),
    ("DALL-E/OpenAI 추정", ("dall-e", "dalle", "openai", "chatgpt")),
    ("Google Imagen/Gemini 추정", ("imagen", "gemini", "google ai studio", "nano banana")),
    ("Adobe Firefly 추정", ("adobe firefly", "firefly")),
    ("Ideogram 추정", ("ideogram",)),
    ("Runway 추정", ("runway",)),
    ("Leonardo.ai 추정", ("leonardo.ai", "leonardo ai")),
    ("NovelAI 추정", ("novelai", "novel ai")),
    ("Recraft 추정", ("recraft",)),
    ("Canva AI 추정", ("canva ai", "magic media")),
    ("Grok/xAI 추정", ("grok", "xai")),
)
# Patterns of agents' texts.
WORKFLOW = (r" step \d+[:.]", r" task \d+[:.]", r" agent[:.]", r" tool[:.]", r" action[:.]", r" observation[:.]", r" thought[:.]", " executing", " processing", " analyzing", " generating", " completed", " finished", " done", " workflow", " pipeline", " automation", " automated")
AUTOMATIC = (r"i (?:have|will|can) (?:now|automatically|programmatically)", r"executing (?:task|command|action)", r"completed (?:task|step|action)", r"running (?:script|code|program)")
# Names of agents.
AGENTS = {
    "openai_agent": ("openai agent", "gpt agent", "chatgpt agent", "operator", "openai operators"),
    "anthropic_agent": ("claude agent", "anthropic agent", "computer use", "claude computer"),
    "google_agent": ("gemini agent", "google agent", "project astra", "google ai studio agent"),
    "microsoft_agent": ("copilot agent", "microsoft agent", "autogen", "semantic kernel"),
    "meta_agent": ("llama agent", "meta agent", "meta ai agent"),
    "langchain": ("langchain", "langgraph", "langsmith", "langchain agent"),
    "crewai": ("crewai", "crew ai", "crewai agent"),
    "autogen": ("autogen", "auto-gen", "pyautogen"),
    "babyagi": ("babyagi", "baby agi"),
    "auto_gpt": ("auto-gpt", "autogpt", "auto gpt"),
    "devin": ("devin", "cognition ai", "devin agent"),
    "sweep": ("sweep ai", "sweep.dev"),
    "cursor_agent": ("cursor agent", "cursor ai", "cursor copilot"),
    "replit_agent": ("replit agent", "replit ai", "replit agent"),
    "openai_swarm": ("openai swarm", "swarm agent"),
    "llamaindex": ("llamaindex", "llama index", "gpt index"),
    "haystack": ("haystack", "deepset"),
    "semantic_kernel": ("semantic kernel", "microsoft semantic"),
    "dspy": ("dspy", "dspy ai"),
    "agentverse": ("agentverse", "agent verse"),
    "metagpt": ("metagpt", "meta gpt"),
}
AI_AUTHORS = r"chatgpt|openai|claude|anthropic|gemini|copilot|midjourney|stable.?diffusion|dall.?e|gamma|jasper|writesonic"
PRINTABLE_KEYWORDS = ("prompt", "parameters", "comfyui", "workflow", "software", "model", "generator")


def joined(metadata: Column) -> Column:
    """A metadata map as lower-cased lines key: value, in key order."""
    rows = F.array_sort(F.map_entries(metadata))
    return F.lower(F.array_join(F.transform(rows, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"))


def image_source(blob: Column) -> tuple[Column, Column]:
    """(label, confidence) of a metadata text: workflow graph, parameter block, tool name, then generic fields."""
    graph = (hits(blob, ("png.workflow", "png.prompt", '"workflow"', "comfyui")) > 0) & (hits(blob, ("ksampler", "checkpointloadersimple", "loraloader", '"class_type"', '"inputs"', '"widgets_values"')) >= 1)
    block = (hits(blob, ("negative prompt", "png.parameters")) > 0) & (hits(blob, ("steps:", "sampler:", "cfg scale", "seed:", "model hash", "model:")) >= 2)
    fields = hits(blob, ("prompt", "negative prompt", "seed", "cfg", "sampler", "model hash", "model_name", "lora", "checkpoint")) >= 2
    label, level = F.when(graph, "ComfyUI 추정").when(block, "AUTOMATIC1111 추정"), F.when(graph | block, "high")
    for name, markers in DIRECT_TOOLS:
        found = blob.rlike(r"(^|\s)(" + "|".join(map(re.escape, markers)) + r")(\s|$)")
        label, level = label.when(found, name), level.when(found, "high")
    return label.when(fields, "생성 메타데이터 추정").otherwise("알 수 없음"), level.when(fields, "medium").otherwise("unknown")


def image_score(confidence: Column, width: Column, height: Column, pixel: Column, model: Column) -> Column:
    """Metadata score of an image: generator, square size, pixel and model scores."""
    tool = F.when(confidence == "high", 67).when(confidence == "medium", 36).otherwise(0)
    square = F.when((width == height) & (width >= 512) & (width % 64 == 0), 9).otherwise(0)
    dots = F.when(pixel >= 82, 61).when(pixel >= 68, 47).when(pixel >= 48, 35).when(pixel >= 32, 18).otherwise(0)
    outer = F.when(model >= 82, 67).when(model >= 65, 42).when(model >= 45, 24).otherwise(0)
    return F.least(F.lit(100), tool + square + dots + outer)


def printable_strings(content: Column, keywords=PRINTABLE_KEYWORDS, least: int = 4, first: int = 80) -> Column:
    """Printable runs of a binary that hold a keyword."""
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"[ -~]{{{least},}}"), F.lit(0))
    return F.slice(F.filter(runs, lambda s: F.lower(s).rlike("|".join(map(re.escape, keywords)))), 1, first)


def marker_score(content: Column, families: dict[str, tuple[str, ...]], weight: int = 10) -> tuple[Column, Column]:
    """(score, band 50/20): families with a marker among the bytes; text is compared as UTF-8."""
    found = [F.greatest(F.lit(0), *[F.contains(content, F.lit(m.encode())).cast("int") for m in markers]) for markers in families.values()]
    score = F.least(F.lit(100), total(found) * weight)
    return score, band(score, 50, 20)


def provenance_records(content: Column, manifest=None, tool=None, vendors: dict[str, str] | None = None) -> dict[str, Column]:
    """Hints of a binary's provenance: ``manifest``, ``tool`` and ``vendor`` records, each a struct or null, and ``confidence``.

    A manifest record has the first of its markers that occurs, a web address
    near it (from 200 bytes before to 500 after) and whether the bytes near it
    speak of a signature.  A tool record has the first of its markers around
    whose first place (50 bytes before, 100 after) over half of the letters are
    printable.  A vendor record has the first of its markers that occurs.  None
    of them is a verified manifest or watermark: confidence is .5 for a manifest
    that speaks of a signature, .3 for another, .4 for a tool or vendor alone,
    null for nothing.  Bytes stand for letters, so places are places of bytes.
    """
    manifest, tool, vendors = manifest or catalogue.MANIFEST, tool or catalogue.GOOGLE, vendors or {marker: name for name, marker in catalogue.VENDORS.items()}
    text = F.decode(content, "ISO-8859-1")
    letters = lambda m: m.encode().decode("latin-1")
    near = lambda at, before, after: F.substring(text, F.greatest(at - before, F.lit(1)), at + after - F.greatest(at - before, F.lit(1)))

    def first(markers, make, good=None):
        out = None
        for m in markers:
            at = F.instr(text, letters(m))
            holds = (at > 0) if good is None else (at > 0) & good(at)
            row = make(m, at)
            out = F.when(holds, row) if out is None else out.when(holds, row)
        return out

    def of_manifest(m, at):
        region = near(at, 200, 500)
        address = F.regexp_extract(region, "http[^\\x00 \"'><]{0,196}", 0)
        signed = F.lower(region).contains("signature") | F.lower(region).contains("signed")
        return F.struct(F.lit("C2PA").alias("standard"), F.lit("CAI").alias("provider"), F.lit(m).alias("marker"), signed.alias("signed"), F.nullif(address, F.lit("")).alias("claim_url"))

    printable = lambda at: F.regexp_count(near(at, 50, 100), F.lit("[ -~\u00a1-\u00ac\u00ae-\u00ff]")) > 0.5 * F.length(near(at, 50, 100))
    plain = lambda provider: lambda m, at: F.struct(F.lit("ToolMetadata").alias("standard"), F.lit(provider(m)).alias("provider"), F.lit(m).alias("marker"))
    found = {"manifest": first(manifest, of_manifest), "tool": first(tool, plain(lambda m: "Google"), printable), "vendor": first(vendors, plain(lambda m: vendors[m]))}
    sure = F.when(found["manifest"]["signed"], 0.5).when(found["manifest"].isNotNull(), 0.3).when(found["tool"].isNotNull() | found["vendor"].isNotNull(), 0.4)
    return found | {"confidence": sure}


def status_counts(rows: DataFrame, by: list[str], status: str = "provenance_status") -> DataFrame:
    """Rows per provenance status; valid, absent, invalid and unavailable stay apart, others are unavailable."""
    four = F.when(F.col(status).isin("valid", "absent", "invalid"), F.col(status)).otherwise("unavailable")
    return rows.groupBy(*by, four.alias("status")).agg(F.count("*").alias("n"))


def folded_source(label: Column, confidence: Column, metadata: Column) -> tuple[Column, Column, Column]:
    """(label, confidence, reasons): an AI tool among a document's creators lifts an unknown source to medium."""
    keys = ("pdf.producer", "pdf.creator", "pdf.author", "docx.creator", "docx.last_modified_by", "docx.application")
    hints = F.filter(F.array(*[F.try_element_at(metadata, F.lit(k)) for k in keys]), lambda v: v.isNotNull() & (v != ""))
    ai = F.exists(hints, lambda v: F.lower(v).rlike(AI_AUTHORS)) & (confidence == "unknown")
    return F.when(ai, "AI 도구 생성 메타데이터 추정").otherwise(label), F.when(ai, "medium").otherwise(confidence), hints


def agent_analysis(text: Column, agents: dict[str, tuple[str, ...]] | None = None) -> dict[str, Column]:
    """Scores of agent names (30 each), workflow patterns (20) and automatic answers (15), with type and band."""
    low = F.lower(F.coalesce(text, F.lit("")))
    known = agents or AGENTS
    found = {name: (hits(low, markers) > 0) for name, markers in known.items()}
    names = total([f.cast("int") for f in found.values()])
    flows = total([low.rlike(p).cast("int") for p in WORKFLOW])
    auto = total([low.rlike(p).cast("int") for p in AUTOMATIC])
    score = F.least(F.lit(100), names * 30 + flows * 20 + auto * 15)
    kind = None
    for vendor in ("openai", "anthropic", "google", "microsoft"):
        any_ = F.lit(False)
        for name, f in found.items():
            any_ = any_ | f if vendor in name else any_
        kind = F.when(any_, f"{vendor}_agent") if kind is None else kind.when(any_, f"{vendor}_agent")
    frame = found.get("langchain", F.lit(False)) | found.get("crewai", F.lit(False))
    n = names + flows + auto
    level = F.when((score >= 67) & (n >= 3), "high").when((score >= 35) & (n >= 1), "medium").otherwise("low")
    return {"score": score, "n_signals": n, "agent_type": kind.when(frame, "framework_agent").otherwise("unknown"), "band": band(score), "confidence": level}


def evidence_confidence(standard: Column, present: Column, state: Column) -> Column:
    return F.when((standard == "C2PA") & present & (F.lower(state) == "valid"), 0.9).when((standard == "C2PA") & present, 0.5).when(standard == "C2PA", 0.3).otherwise(0.4)


def family_score(text: Column, metadata: Column, path: Column, families: dict[str, dict[str, tuple[str, ...]]], weights: dict[str, int]) -> Column:
    """Sum over families and fields (metadata, text, extension) of the weight where a marker occurs."""
    fields = {"metadata": F.lower(F.coalesce(metadata, F.lit(""))), "text": F.lower(F.coalesce(text, F.lit("")))}
    score = F.lit(0)
    for markers in families.values():
        for field, column in fields.items():
            if markers.get(field):
                score = score + F.when(hits(column, markers[field]) > 0, weights[field]).otherwise(0)
        if markers.get("extension"):
            score = score + F.when(F.lower(path).rlike("(" + "|".join(re.escape(e) for e in markers["extension"]) + ")$"), weights["extension"]).otherwise(0)
    return F.least(F.lit(100), score)


def tokens(docs: DataFrame, id_col: str, text_col: str, vocabulary: int = 1000) -> DataFrame:
    """Rows (id, pos, token) of the words of texts, hashed into a vocabulary."""
    w = F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    number = F.conv(F.substring(F.sha2(F.col("w"), 256), 1, 8), 16, 10).cast("long") % vocabulary
    return docs.select(id_col, F.posexplode(w).alias("pos", "w")).select(id_col, "pos", number.alias("token"))


def keyed_unit(key: str, *parts: Column) -> Column:
    """A number in [0, 1) from a secret and parts."""
    h = F.sha2(F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def green_test(token_rows: DataFrame, id_col: str, secret: str, gamma: float = 0.25, least: int = 32) -> DataFrame:
    """Rows (id, n, greens, z, score): tokens in their context's keyed green list against the expected share."""
    before = F.lag("token").over(Window.partitionBy(id_col).orderBy("pos"))
    d = token_rows.withColumn("before", before).where("before IS NOT NULL")
    out = d.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if(keyed_unit(secret, F.col("before"), F.col("token")) < gamma).alias("greens")).where(F.col("n") >= least)
    z = (F.col("greens") - gamma * F.col("n")) / F.sqrt(F.col("n") * gamma * (1 - gamma))
    return out.withColumn("z", z).withColumn("score", clamp((F.col("z") / 8 * 100).cast("int"), 0, 100))


def mean_g_test(token_rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Rows (id, trials, mean_g, z): mean keyed value of token pairs over all keys against one half."""
    before = F.lag("token").over(Window.partitionBy(id_col).orderBy("pos"))
    d = token_rows.withColumn("before", before).where("before IS NOT NULL")
    values = [keyed_unit(k, F.col("before"), F.col("token")) for k in keys]
    out = d.groupBy(id_col).agg((F.count("*") * len(keys)).alias("trials"), F.avg(total(values) / len(keys)).alias("mean_g"))
    return out.withColumn("z", (F.col("mean_g") - 0.5) / F.sqrt(1 / (12.0 * F.col("trials"))))


def perplexity(nll: DataFrame, id_col: str, window: int = 512, least: int = 32, low: float = 8.0, high: float = 60.0, ratio_low: float = 0.85, ratio_high: float = 1.05) -> DataFrame:
    """Rows (id, ppl, burst_cv, ppl_score, ratio, ratio_score) of token costs (id, view, pos, nll, xnll).

    The view of least perplexity counts (of least ratio for the ratio); views
    under ``least`` tokens do not.  burst_cv needs three windows.
    """
    parts = nll.groupBy(id_col, "view", F.floor(F.col("pos") / window).alias("w")).agg(F.avg("nll").alias("m"), F.sum("nll").alias("s"), F.sum("xnll").alias("x"), F.count("*").alias("n"))
    views = parts.groupBy(id_col, "view").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("x").alias("x"), F.when(F.count("*") >= 3, F.stddev_pop("m") / F.greatest(F.lit(1e-9), F.avg("m"))).otherwise(0.0).alias("cv")).where(F.col("n") >= least)
    views = views.withColumns({"ppl": F.exp(F.least(F.lit(20.0), F.col("s") / F.col("n"))), "ratio": F.col("s") / F.greatest(F.col("x"), F.lit(1e-9))})
    best = views.groupBy(id_col).agg(F.min_by(F.struct("ppl", "cv"), F.struct("ppl", "view")).alias("b"), F.min("ratio").alias("ratio"))
    import math

    span = math.log(high) - math.log(low)
    return best.select(
        id_col,
        F.col("b.ppl").alias("ppl"),
        F.col("b.cv").alias("burst_cv"),
        F.bround(clamp(100 * (math.log(high) - F.ln(F.greatest(F.col("b.ppl"), F.lit(1e-9)))) / span, 0.0, 100.0)).cast("int").alias("ppl_score"),
        "ratio",
        F.bround(clamp(100 * (ratio_high - F.col("ratio")) / (ratio_high - ratio_low), 0.0, 100.0)).cast("int").alias("ratio_score"),
    )
