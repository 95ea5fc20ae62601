"""Audit of stored passages against the texts they were cut from, passage by passage.

Counts do not prove an index: identities, revisions, offsets, texts, links and complete
sequences must agree. Texts never travel with every passage: passages are dealt into
blocks of neighbours, a text is cut once into the piece that each block spans, and only
pieces meet passages, of which digests stand for the texts. What is compared with a piece
is settled where the two meet, and no piece goes further. Neighbours in different blocks meet by the blocks' edges, so no
paper's passages are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.functions.text import unreadable

#: Passages of a block; errors that a report lists.
BLOCK, LISTED = 128, 100

#: What can be wrong with a passage; each passage has the first that holds.
KINDS = ("unknown paper", "unreadable paper", "identity", "duplicate", "number", "text", "link")


def papers_of(sources: DataFrame, revision: Column) -> DataFrame:
    """(paper, revision, text, link, skipped, changed) of sources (paper, sha256, text, link): what the audit expects of each.

    `revision` says what revision a source's digest makes. Unreadable texts are skipped; a
    text whose digest is not the stated one is changed. A null text is empty. One row for
    each paper is expected; of repeated ones any is taken.
    """
    text = F.coalesce("text", F.lit(""))
    changed = ~F.sha2(text.cast("binary"), 256).eqNullSafe(F.col("sha256"))
    told = sources.select("paper", revision.alias("revision"), text.alias("text"), "link", (unreadable(text) & ~changed).alias("skipped"), changed.alias("changed"))
    return told.where("paper IS NOT NULL").dropDuplicates(["paper"])


def _whole(c: Column) -> Column:
    """A number as one that positions in a text can have."""
    return F.greatest(F.least(c, F.lit((1 << 31) - 1)), F.lit(-(1 << 31) + 1)).cast("int")


def _digest(text: Column) -> Column:
    """What stands for a text where it would travel; null for null."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _pieces(numbered: DataFrame, papers: DataFrame, records: DataFrame) -> DataFrame:
    """For each block of passages of a known paper what is known of the paper, and what of its text the block spans, with what lies between it and the block before."""
    spans = numbered.groupBy("paper", "block").agg(F.min("char_start").alias("a"), F.max("char_end").alias("b"), F.max_by("char_end", "chunk").alias("edge"))
    order = Window.partitionBy("paper").orderBy("block")
    next_to = (F.col("block") > 0) & (F.lag("block").over(order) == F.col("block") - 1)
    spans = spans.withColumn("edge_before", F.when(next_to, F.lag("edge").over(order))).withColumn("low", F.greatest(F.least("a", "edge_before"), F.lit(0)))
    each = spans.groupBy("paper").agg(F.collect_list(F.struct("block", "low", "b", "edge_before")).alias("spans"))  # a row for BLOCK passages
    totals = records.select("paper", F.col("total").alias("__total")).dropDuplicates(["paper"])
    texts = papers.select("paper", F.col("revision").alias("__revision"), F.col("link").alias("__link"), "skipped", "text").join(each, "paper").join(totals, "paper", "left")
    piece = lambda s: F.when(s["block"] >= 0, F.substring(F.col("text"), _whole(s["low"] + 1), _whole(F.greatest(s["b"] - s["low"], F.lit(0)))))
    cut = F.transform("spans", lambda s: F.struct(s["block"].alias("block"), s["low"].alias("low"), s["edge_before"].alias("edge_before"), piece(s).alias("piece")))
    facts = ["__revision", "__link", "skipped", "__total"]
    out = texts.select("paper", *facts, F.length("text").cast("long").alias("__length"), F.explode(cut).alias("x"))
    return out.select("paper", "x.block", "x.low", "x.edge_before", "x.piece", *facts, "__length", F.lit(True).alias("__known"))


def passages(stored: DataFrame, papers: DataFrame, records: DataFrame, key: Column | None = None) -> DataFrame:
    """(id, paper, chunk, problem, gap): every stored passage with the first thing wrong with it, null if nothing is.

    stored: id, paper, revision, chunk, char_start, char_end, document, link; papers: what
    `papers_of` gives; records: paper, total. An id is `key:revision:chunk`, where `key` is
    the sha256 of the paper unless another is given. `gap` says that there is text between
    a passage and the one before that neither holds, or that it begins no later than the
    one of the number before. Null chunks and offsets are wrong numbers and wrong texts; rows repeat as
    they come, and all of an id's rows but one are duplicates.
    """
    key = F.sha2(F.col("paper").cast("binary"), 256) if key is None else key
    whole = (F.col("chunk") >= 0) & (F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start"))
    block = F.when(F.coalesce(whole, F.lit(False)), F.floor(F.col("chunk") / BLOCK)).otherwise(F.lit(-1)).cast("long")
    numbered = stored.select("id", "paper", "revision", "chunk", "char_start", "char_end", _digest(F.col("document")).alias("digest"), "link", block.alias("block"))
    ordered = Window.partitionBy("paper", "block").orderBy("chunk", "char_start", "id")
    start_before = F.when((F.col("block") >= 0) & (F.lag("chunk").over(ordered) < F.col("chunk")), F.lag("char_start").over(ordered))
    told = numbered.withColumn("__end", F.lag("char_end").over(ordered)).withColumn("__start", start_before)
    told = told.join(_pieces(numbered, papers, records), ["paper", "block"], "left")
    last = F.when(F.col("block") >= 0, F.coalesce("__end", "edge_before", F.when(F.col("block") == 0, 0)))
    at = lambda a, b: F.col("piece").substr(_whole(a - F.col("low") + 1), _whole(b - a))
    right_text = (F.col("char_end") <= F.col("__length")) & (_digest(at(F.col("char_start"), F.col("char_end"))) == F.col("digest"))
    between = F.when(last < F.col("char_start"), at(last, F.col("char_start")))
    gap = F.coalesce(between.rlike(r"(?U)\S"), F.lit(False)) | F.coalesce(F.col("char_start") <= F.col("__start"), F.lit(False))
    good = {
        "unknown paper": F.col("__known"), "unreadable paper": ~F.col("skipped"),
        "identity": F.col("id").eqNullSafe(F.concat_ws(":", key, "__revision", F.col("chunk").cast("string"))) & (F.col("revision") == F.col("__revision")),
        "number": (F.col("chunk") >= 0) & (F.col("chunk") < F.col("__total")),
        "text": (F.col("block") >= 0) & right_text, "link": F.col("link").eqNullSafe(F.col("__link")),
    }
    first = lambda kinds: F.coalesce(*(F.when(~F.coalesce(good[k], F.lit(False)), F.lit(k)) for k in kinds))
    at_copies = KINDS.index("duplicate")
    told = told.select("id", "paper", "chunk", "char_start", "char_end", first(KINDS[:at_copies]).alias("__before"), first(KINDS[at_copies + 1 :]).alias("__after"), gap.alias("gap"))
    # rows of one id meet in the partition of the id's neighbours, of which an id names the block, so that what neighbours share is packed together
    number = F.regexp_extract("id", r"(\d+)$", 1)
    near = [F.regexp_replace("id", r"\d+$", "").alias("__stem"), F.coalesce(F.floor(number.try_cast("long") / BLOCK), F.lit(-1)).alias("__near")]
    told = told.select("*", *near).repartition("__stem", "__near")
    nth = F.row_number().over(Window.partitionBy("__stem", "__near", "id").orderBy("paper", "chunk", "char_start", "char_end"))
    problem = F.coalesce("__before", F.when(F.col("__nth") > 1, F.lit("duplicate")), "__after")
    return told.withColumn("__nth", nth).select("id", "paper", "chunk", problem.alias("problem"), "gap")


def checkpoints(audited: DataFrame, papers: DataFrame, records: DataFrame) -> DataFrame:
    """(paper, total, found, problem) of every paper that is known, recorded or stored: what its checkpoint gets wrong, null if nothing.

    records: paper, revision, next_chunk, total, state.
    """
    r = records.select("paper", F.col("revision").alias("__r"), "next_chunk", "total", "state").dropDuplicates(["paper"])
    counts = audited.groupBy("paper").agg(F.count("*").alias("stored"), F.count_if(F.col("problem").isNull()).alias("found"), F.count_if("gap").alias("gaps"))
    both = papers.select("paper", "revision", "skipped", "changed", F.lit(True).alias("__known")).join(r, "paper", "full").join(counts, "paper", "full")
    complete = (F.col("state") == "ready") & F.col("__r").eqNullSafe(F.col("revision")) & (F.col("next_chunk") == F.col("total")) & (F.col("total") >= 1)
    problem = (
        F.when(F.col("__known").isNull(), F.lit("unknown paper")).when(F.col("changed"), F.lit("changed since conversion"))
        .when(F.col("skipped"), F.when(F.col("stored") > 0, F.lit("unreadable but stored"))).when(~F.coalesce(complete, F.lit(False)), F.lit("checkpoint"))
        .when(F.coalesce("found", F.lit(0)) != F.col("total"), F.lit("count")).when(F.col("gaps") > 0, F.lit("gap"))
    )
    skipped = F.coalesce("skipped", F.lit(False))
    return both.select("paper", F.when(skipped, F.lit(0)).otherwise(F.coalesce("total", F.lit(0))).cast("long").alias("total"), F.coalesce("found", F.lit(0)).alias("found"), skipped.alias("skipped"), F.coalesce("__known", F.lit(False)).alias("known"), problem.alias("problem"))


def report(audited: DataFrame, checked: DataFrame, before: DataFrame, after: DataFrame, listed: int = LISTED) -> DataFrame:
    """One row: totals, the first errors by paper and id, whether nothing moved meanwhile, and two verdicts.

    before, after: (paper, revision, total, state) of the records at the two ends of the
    audit. `all_ready` says that every known paper is verified and none was skipped;
    `all_eligible` leaves skipped ones aside. The first `listed` errors come from a top-n,
    so only these meet.
    """
    errors = audited.where("problem IS NOT NULL").select("paper", F.coalesce("id", F.lit("")).alias("id"), "problem")
    errors = errors.unionByName(checked.where("problem IS NOT NULL").select("paper", F.lit("").alias("id"), "problem"))
    errors = scratch.materialize(errors, "errors")
    first = errors.orderBy(F.asc_nulls_first("paper"), "id", "problem").limit(listed)
    texts = first.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("paper", F.lit("")).alias("paper"), "id", "problem"))).alias("errors"))
    state = [x.groupBy("paper", "revision", "total", "state").agg(F.count("*").alias("n")).select("paper", "revision", "total", "state", "n", F.lit(s).alias("s")) for x, s in ((before, 1), (after, -1))]
    moved = state[0].unionByName(state[1]).groupBy("paper", "revision", "total", "state").agg(F.sum(F.col("n") * F.col("s")).alias("d")).agg((F.count_if(F.col("d") != 0) == 0).alias("stable"))
    totals = checked.agg(F.count_if("known").alias("papers"), F.count_if("skipped").alias("skipped"), F.coalesce(F.sum("total"), F.lit(0)).alias("expected"))
    counts = audited.agg(F.count("*").alias("passages"), F.count_if("gap").alias("gaps"))
    wrong = errors.agg(F.count("*").alias("n_errors"))
    out = totals.crossJoin(counts).crossJoin(wrong).crossJoin(moved).crossJoin(texts)  # one row each
    sound = (F.col("n_errors") == 0) & F.col("stable") & (F.col("passages") == F.col("expected"))
    return out.select(
        "papers", "skipped", "expected", "passages", "gaps", "n_errors", "stable", F.transform("errors", lambda e: F.concat_ws(" | ", e["paper"], e["id"], e["problem"])).alias("errors"),
        (sound & (F.col("papers") > 0) & (F.col("skipped") == 0)).alias("all_ready"), (sound & (F.col("papers") > F.col("skipped"))).alias("all_eligible"),
    )
