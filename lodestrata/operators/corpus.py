"""Documents as blocks and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import ranked


def block_lines(text: Column) -> Column:
    """A text's lines that aren't blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x) != "")


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, ord (from 0), n (blocks of the document), text."""
    lines = docs.select("doc_id", block_lines(F.col("text")).alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n"), F.posexplode("l").alias("ord", "text")).select("doc_id", F.col("ord").cast("long").alias("ord"), "n", "text")


def section_at(ord_: Column, n: Column) -> Column:
    """A section by relative place, for material without headings."""
    return F.when(ord_ == 0, "Title").when(ord_ * 100 < n * 25, "Abstract").when(ord_ * 100 < n * 45, "Introduction").when(ord_ * 100 < n * 60, "Methods").when(ord_ * 100 < n * 80, "Results").otherwise("Discussion")


def chunks(docs: DataFrame, size: int = 4, page: int = 3) -> DataFrame:
    """Chunks of ``size`` blocks each: a map over documents, without a shuffle.

    chunk_id, doc_id, source_file, title (first block, 80 characters), section, page_start, page_end, chunk_index, token_count, text;
    text with cells between bars is marked as table text.
    """
    lines = docs.select("doc_id", F.col("source").alias("source_file"), block_lines(F.col("text")).alias("l")).where(F.size("l") > 0)
    n = F.size("l")
    lines = lines.select("*", n.alias("n"), F.explode(F.sequence(F.lit(0), F.expr(f"(size(l) - 1) div {size}").cast("int"))).alias("chunk_index"))
    body = F.array_join(F.slice("l", F.col("chunk_index") * size + 1, size), "\n")
    lines = lines.select("doc_id", "source_file", F.substring(F.col("l")[0], 1, 80).alias("title"), section_at(F.col("chunk_index") * size, F.col("n")).alias("section"), F.col("chunk_index").cast("long").alias("chunk_index"), body.alias("body"))
    marked = F.when(F.contains("body", F.lit(" | ")), F.concat(F.lit("[TABLE TEXT] "), "body")).otherwise(F.col("body"))
    at = (F.floor(F.col("chunk_index") / page) + 1).cast("long")
    return lines.select(F.concat(F.col("doc_id").cast("string"), F.lit("_c"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "source_file", "title", "section", at.alias("page_start"), at.alias("page_end"), "chunk_index", T.word_count("body").alias("token_count"), marked.alias("text"))


def quality_filter(chunk_rows: DataFrame, chars: int = 50, words: int = 10, least: float = 0.3, table: tuple[int, int, float] = (20, 3, 0.05)) -> DataFrame:
    """Chunks that are long and good enough, table text by laxer limits, numbered anew within their document.

    The score comes out of a generator of one row, below which the optimizer can't push the filter, so it is computed once.
    """
    is_table = F.contains("text", F.lit("[TABLE TEXT]"))
    rows = chunk_rows.select("*", F.inline(F.array(F.struct(F.char_length("text").alias("_n"), T.word_count("text").alias("_w"), T.quality("text").alias("quality_score")))))
    n, w, q = F.col("_n"), F.col("_w"), F.col("quality_score")
    strict, lax = (n >= chars) & (w >= words) & (q >= least), (n >= table[0]) & (w >= table[1]) & (q >= table[2])
    kept = rows.where(F.when(is_table, lax).otherwise(strict)).drop("_n", "_w")
    kept = ranked(kept, ["doc_id"], [F.col("chunk_index")], "_r")
    return kept.withColumn("chunk_index", (F.col("_r") - 1).cast("long")).drop("_r")


def packed(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Blocks packed greedily into chunks of at most ``size`` words, each but the first begun with the last ``overlap`` words
    of the one before (none if that has no more): doc_id, chunk_no, n_words (overlap included), first_ord, last_ord, text.

    The fold stays in the JVM: it goes over a document's word counts once and notes only where chunks begin; texts are put
    together from these places afterwards, each word once (twice in an overlap). A block longer than size is a chunk of its own.
    """
    lines = docs.select("doc_id", F.transform(block_lines(F.col("text")), lambda x: T.words(x)).alias("l")).where(F.size("l") > 0)
    begin = "named_struct('cuts', cast(array() as array<struct<first:int,lead:int>>), 'n', 0, 'own', 0)"
    lead = f"if(size(a.cuts) = 0 or {overlap} = 0 or a.own <= {overlap}, 0, {overlap})"
    step = f"""if(size(a.cuts) > 0 and a.n + b.n <= {size}, named_struct('cuts', a.cuts, 'n', a.n + b.n, 'own', a.own + b.n),
        named_struct('cuts', concat(a.cuts, array(named_struct('first', b.i, 'lead', {lead}))), 'n', {lead} + b.n, 'own', b.n))"""
    cut = lines.withColumn("cuts", F.expr(f"aggregate(transform(l, (w, i) -> named_struct('i', i, 'n', size(w))), {begin}, (a, b) -> {step}).cuts"))
    own = "slice(l, c.first + 1, if(k + 1 < size(cuts), cuts[k + 1].first, size(l)) - c.first)"
    before = f"if(c.lead = 0, cast(array() as array<string>), slice(flatten(slice(l, cuts[k - 1].first + 1, c.first - cuts[k - 1].first)), -{max(1, overlap)}, {max(1, overlap)}))"
    whole = cut.select("doc_id", F.posexplode(F.expr(f"transform(cuts, (c, k) -> named_struct('first', c.first, 'last', if(k + 1 < size(cuts), cuts[k + 1].first, size(l)) - 1, 'w', concat({before}, flatten({own}))))")).alias("chunk_no", "c"))
    return whole.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.size("c.w").cast("long").alias("n_words"), F.col("c.first").cast("long").alias("first_ord"), F.col("c.last").cast("long").alias("last_ord"), F.array_join("c.w", " ").alias("text"))


def with_sections(rows: DataFrame, heading: Column, by: str = "doc_id", order: str = "ord") -> DataFrame:
    """Gaps and islands: section_no and the heading that holds, carried forward from the last heading at or before each row."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumns({"section_no": F.sum(heading.cast("long")).over(w), "section": F.last(F.when(heading, F.btrim("text")), ignorenulls=True).over(w)})


def repeated_lines(rows: DataFrame, least: int = 3, most_words: int = 15) -> DataFrame:
    """Short lines that a document has ``least`` times or more, as running headers and footers: doc_id, text, n. What other documents have doesn't count."""
    short = rows.where(T.word_count("text") <= most_words).groupBy("doc_id", F.btrim("text").alias("text"))
    return short.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def merged_headings(rows: DataFrame) -> DataFrame:
    """Neighbouring headings joined to one when the first ends on a word that calls for more, or the next goes on in small letters."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    prev, open_ = F.lag("text").over(w), T.edges(r"(?i)\b(of|and|the|for|in|on|with|to|by|de|der|des|et|y)$")
    goes_on = F.lag(F.col("heading")).over(w) & F.col("heading") & (prev.rlike(open_) | F.col("text").rlike(r"^[a-zäöüéèñ]"))
    runs = rows.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    parts = runs.groupBy("doc_id", "_run").agg(F.min("ord").alias("ord"), F.max("ord").alias("last_ord"), F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return parts.select("doc_id", "ord", "last_ord", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def reference_runs(rows: DataFrame, gap: int = 3, least: int = 2) -> DataFrame:
    """Runs of bibliography entries at most ``gap`` blocks apart with ``least`` entries: doc_id, first_ord, last_ord, n."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    refs = rows.where(T.reference_line("text")).withColumn("_new", F.coalesce((F.col("ord") - F.lag("ord").over(w) > gap).cast("int"), F.lit(1)))
    refs = refs.withColumn("run", F.sum("_new").over(w))
    return refs.groupBy("doc_id", "run").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("run")


def needs_fallback(rows: DataFrame) -> DataFrame:
    """doc_id and whether its sections are useless: under a tenth of its words in body sections and over 80 % in title, abstract
    or unknown ones, with at least three blocks. rows: doc_id, section, token_count."""
    g = T.section_group("section")
    body = F.when(g.isin("INTRO", "METHOD", "RESULT", "DISCUSSION", "CONCLUSION", "BODY_ANY"), F.col("token_count")).otherwise(0)
    front = F.when(g.isin("TITLE", "ABSTRACT", "UNKNOWN"), F.col("token_count")).otherwise(0)
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("token_count").alias("words"), F.sum(body).alias("body_words"), F.sum(front).alias("front_words"))
    return per.withColumn("fallback", (F.col("n_blocks") >= 3) & (F.col("body_words") * 10 < F.col("words")) & (F.col("front_words") * 10 > F.col("words") * 8))


def table_context(rows: DataFrame, blocks_away: int = 40) -> DataFrame:
    """rows with in_table: a table caption or table line came before, no heading or paragraph since, at most ``blocks_away`` blocks ago."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    opens = F.col("kind").isin("table_caption", "table_text")
    closes = F.col("kind").isin("heading", "figure_caption") | ((F.col("kind") == "paragraph") & T.body_line("text"))
    seen = rows.withColumns({"_o": F.last(F.when(opens, F.col("ord")), ignorenulls=True).over(w), "_c": F.last(F.when(closes, F.col("ord")), ignorenulls=True).over(w)})
    inside = F.col("_o").isNotNull() & (F.col("_o") > F.coalesce("_c", F.lit(-1))) & (F.col("ord") - F.col("_o") <= blocks_away)
    return seen.withColumn("in_table", inside).drop("_o", "_c")


def page_spans(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows(doc_id, ord, text, ...) with page_start and page_end, by the characters before a block's begin and end: each is on the first page
    whose running end reaches it; beyond the last page they are the first and the last. pages: doc_id, page, n_chars, in the order of page.
    A document without pages or without characters on them has none.

    A sweep instead of a range join: blocks' places and pages' ends are one sorted run for each document, in which the page is carried
    from the end backwards, so work is linear in both, and nothing is compared with all pages.
    """
    w = lambda *order: Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = pages.select("doc_id", "page", F.sum(F.coalesce("n_chars", F.lit(0))).over(w("page")).alias("_at"))
    known = ends.groupBy("doc_id").agg(F.min("page").alias("_first"), F.max("page").alias("_last"), F.max("_at").alias("_all")).where("_all > 0")
    size = F.char_length(F.coalesce("text", F.lit(""))) + 1
    blocks_ = rows.withColumn("_end", F.sum(size).over(w("ord"))).withColumn("_begin", F.col("_end") - size)
    places = blocks_.select("doc_id", "ord", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("_begin").alias("at")), F.struct(F.lit(2).alias("k"), F.col("_end").alias("at")))).alias("p"))
    none = lambda kind: F.lit(None).cast(kind)
    page_type = dict(pages.dtypes)["page"]
    run = ends.select("doc_id", F.col("_at").cast("long").alias("at"), F.lit(0).alias("k"), "page", none(dict(rows.dtypes)["ord"]).alias("ord"))
    run = run.unionByName(places.select("doc_id", F.col("p.at").cast("long").alias("at"), F.col("p.k").alias("k"), none(page_type).alias("page"), "ord"))
    back = [F.desc("at"), F.asc("k"), F.desc_nulls_last("page"), F.desc("ord")]  # of pages that end at one place the first counts
    swept = run.withColumn("page", F.last("page", ignorenulls=True).over(w(*back))).where("k > 0")
    found = swept.groupBy("doc_id", "ord").agg(F.max(F.when(F.col("k") == 1, F.col("page"))).alias("page_start"), F.max(F.when(F.col("k") == 2, F.col("page"))).alias("page_end"))
    out = rows.join(found, ["doc_id", "ord"], "left").join(known, "doc_id", "left")
    start, end = F.coalesce("page_start", "_first"), F.coalesce("page_end", "_last")
    return out.withColumns({"page_start": F.when(F.col("_all").isNotNull(), start), "page_end": F.when(F.col("_all").isNotNull(), end)}).drop("_first", "_last", "_all")


def page_ranges(rows: DataFrame, chars: int = 3000) -> DataFrame:
    """rows with the pages on which a block begins and ends, if a page holds ``chars`` characters: a running sum by document."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.char_length("text") + 1).over(w)
    rows = rows.withColumn("_end", end)
    return rows.withColumns({"page_start": (F.floor((F.col("_end") - F.char_length("text") - 1) / chars) + 1).cast("long"), "page_end": (F.floor((F.col("_end") - 1) / chars) + 1).cast("long")}).drop("_end")


def title_candidates(rows: DataFrame, most: int = 20) -> DataFrame:
    """Each document's title: the best-scored of its first ``most`` lines, the earliest of equals."""
    w = T.word_count("text")
    score = (
        F.when(w.between(4, 25), 3).otherwise(0) + F.when(F.col("text").rlike(r"^[A-ZÄÖÜÉÈÑ]"), 2).otherwise(0) - F.when(T.noise_line("text"), 5).otherwise(0)
        - F.when(T.heading_line("text"), 1).otherwise(0) - F.when(F.col("text").rlike(r"[.;,]$"), 1).otherwise(0) - F.when(T.table_line("text"), 3).otherwise(0)
    )
    rows = rows.where(F.col("ord") < most).withColumn("score", score.cast("long"))
    return rows.groupBy("doc_id").agg(F.max_by("text", F.struct("score", -F.col("ord"))).alias("title"), F.max("score").alias("score"))
