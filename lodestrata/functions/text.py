"""Column functions over text: tokens, normal forms, predicates, scores. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import Lexicon

TOKEN = r"[A-Za-z0-9_+-]+|[一-鿿]"
ASCII_TOKEN = r"[a-z0-9]+"
CJK = r"[一-鿿]"
WHITE = r"[ \t\n\x0B\f\r]+"
#: The edge of an ASCII word. Java's own mark takes accented letters for word characters, so it finds no edge in "SSö" and none before "tat" in "état".
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def edges(pattern: str) -> str:
    """The pattern with edges of ASCII words for its word boundaries."""
    return pattern.replace(r"\b", EDGE)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column) -> Column:
    """The text lower-cased, once and not word by word; the two signs that would become ASCII letters (dotted I, Kelvin) become spaces."""
    return F.lower(F.replace(F.replace(c, F.lit("\u0130"), F.lit(" ")), F.lit("\u212a"), F.lit(" ")))


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits, _, + and -, and single Chinese characters; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN.replace("A-Za-z", "a-z")), F.lit(0))


def ascii_tokens(c: Column | str, doubled: tuple[str, ...] = ("table", "figure")) -> Column:
    """Runs of ASCII letters and digits; the words that mark structure count twice."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(ASCII_TOKEN), F.lit(0))
    return F.flatten(F.transform(found, lambda t: F.when(t.isin(*doubled), F.array(t, t)).otherwise(F.array(t))))


def long_words(c: Column | str) -> Column:
    """Distinct runs of two or more word characters or Chinese characters, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[a-z0-9_一-鿿]{2,}"), F.lit(0)))


def terms(c: Column | str) -> Column:
    """Distinct ASCII words of three or more letters, and pairs of neighbouring Chinese characters."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9][a-z0-9_+'-]{2,}"), F.lit(0))
    signs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    pairs = F.when(F.size(signs) > 1, F.transform(F.sequence(F.lit(1), F.size(signs) - 1), lambda i: F.concat(F.element_at(signs, i), F.element_at(signs, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def words(c: Column | str) -> Column:
    """White-space words; none for null or blank."""
    return F.array_remove(F.split(F.coalesce(col(c), F.lit("")), WHITE), "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c)).cast("long")


def has_any(c: Column | str, needles: tuple[str, ...] | list[str]) -> Column:
    """Whether the text has one of the strings; null counts as empty."""
    text = F.coalesce(col(c), F.lit(""))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles], F.lit(False))


def count_of(c: Column | str, needles: tuple[str, ...]) -> Column:
    """How many of the strings the text has."""
    text = F.coalesce(col(c), F.lit(""))
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(n)).cast("int") for n in needles], F.lit(0))


def normal(c: Column | str) -> Column:
    """Lower-cased, with plain primes and dashes, _ as a space, fig. spelled out, white space squeezed."""
    c = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), "′’‘–—−_", "'''--- ")
    return F.btrim(F.regexp_replace(F.replace(c, F.lit("fig."), F.lit("figure ")), WHITE, " "))


def compact(c: Column | str) -> Column:
    """The normal form without spaces, slashes, _ and -."""
    return F.regexp_replace(normal(c), r"[ \t\n\x0B\f\r/_-]+", "")


def squeezed(c: Column | str, limit: int) -> Column:
    """White space squeezed; what is longer than limit ends in three dots."""
    s = F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), WHITE, " "))
    return F.when(F.char_length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("...")))


def ratio_of(c: Column | str, letters: str) -> Column:
    """Part of the text's characters that the pattern matches."""
    c = F.coalesce(col(c), F.lit(""))
    return F.char_length(F.regexp_replace(c, f"[^{letters}]+", "")) / F.greatest(F.char_length(c), F.lit(1))


def quality(c: Column | str) -> Column:
    """1 less penalties for few characters or words, few letters, many digits and repeated words; 0 for null or empty.

    The counts are one struct to which the score refers, so the text is split and scanned once. Penalties are hundredths, and so is the
    score: in doubles 1 - 0.3 - 0.2 - 0.2 is less than 0.3, and a text on that limit would be dropped.
    """
    text = F.coalesce(col(c), F.lit(""))
    counts = F.struct(
        F.char_length(text).alias("n"), F.size(words(text)).alias("w"), F.size(F.array_distinct(words(F.lower(text)))).alias("distinct"),
        ratio_of(text, r"\p{L}").alias("letters"), ratio_of(text, r"\p{Nd}").alias("digits"),
    )

    def score(x: Column) -> Column:
        n, w, letters = x["n"], x["w"], x["letters"]
        points = (
            F.lit(1.0)
            - F.when(n < 50, 0.4).when(n < 100, 0.2).otherwise(0.0)
            - F.when(w < 10, 0.3).when(w < 20, 0.15).otherwise(0.0)
            - F.when(letters < 0.5, 0.3).when(letters < 0.7, 0.1).otherwise(0.0)
            - F.when(x["digits"] > 0.3, 0.2).otherwise(0.0)
            - F.when((w > 0) & (x["distinct"] / F.greatest(w, F.lit(1)) < 0.2), 0.2).otherwise(0.0)
        )
        return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(points, 2))))

    return F.element_at(F.transform(F.array(counts), score), 1)


def headed(title: str, section: str, source: str, doc: str, text: str, sep: str = " ") -> Column:
    """The text under lines that name its title, section, file and document; empty ones are left out."""
    lines = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(label + sep), F.col(c).cast("string"))) for label, c in (("title", title), ("section", section), ("source_file", source), ("doc_id", doc))]
    return F.concat_ws("\n", *lines, F.coalesce(F.col(text), F.lit("")))


def noise_line(c: Column | str) -> Column:
    """Page numbers, DOIs, copyright and the like."""
    c = F.btrim(F.coalesce(col(c), F.lit("")))
    return c.rlike(edges(r"(?i)^(page )?\d{1,4}( of \d+)?$|^https?://\S+$|\bdoi[:.]|^(copyright|©|\(c\))|all rights reserved|^licensed under|^received:? |^accepted:? |^www\."))


def heading_line(c: Column | str) -> Column:
    """A numbered or marked heading, or one of the usual section names alone on a line."""
    c = F.btrim(F.coalesce(col(c), F.lit("")))
    return c.rlike(r"^#{1,3} \S|^\d+(\.\d+)*\.? [A-Z]\S*( \S+){0,9}$|(?i)^(abstract|introduction|background|methods|materials and methods|results|results and discussion|discussion|conclusions?|references)$") & ~noise_line(c) & ~c.rlike(r"[.;,]$")


def reference_line(c: Column | str) -> Column:
    """A numbered entry of a bibliography."""
    return F.btrim(F.coalesce(col(c), F.lit(""))).rlike(r"^(\[\d{1,3}\]|\d{1,3}\.) .*(19|20)\d\d")


def table_line(c: Column | str) -> Column:
    """Cells between bars, or mostly numbers."""
    c = F.coalesce(col(c), F.lit(""))
    return (F.size(F.split(c, r"\|")) >= 4) | ((F.size(words(c)) >= 4) & (F.size(F.filter(words(c), lambda w: w.rlike(r"^[-+]?\d"))) * 2 > F.size(words(c))))


def body_line(c: Column | str) -> Column:
    """Long enough for a paragraph and neither heading, noise, table nor reference."""
    c = col(c)
    return (F.char_length(F.coalesce(c, F.lit(""))) >= 20) & ~noise_line(c) & ~heading_line(c) & ~table_line(c) & ~reference_line(c)


def line_kind(c: Column | str) -> Column:
    """The first that holds of: noise, heading, reference, table_text, figure_caption, table_caption, paragraph."""
    c = col(c)
    return (
        F.when(noise_line(c), "noise").when(heading_line(c), "heading").when(reference_line(c), "reference").when(table_line(c), "table_text")
        .when(c.rlike(r"(?i)^fig(ure|\.) ?[a-z]?\d+"), "figure_caption").when(c.rlike(r"(?i)^table ?[a-z]?\d+"), "table_caption").otherwise("paragraph")
    )


def section_group(c: Column | str) -> Column:
    """The group of a section by its exact name."""
    s = F.btrim(F.lower(F.coalesce(col(c), F.lit(""))))
    return (
        F.when(s.isin("introduction", "background"), "INTRO").when(s.isin("methods", "materials and methods", "experimental section", "experimental procedures", "experimental methods"), "METHOD")
        .when(s.isin("results", "results and discussion"), "RESULT").when(s.isin("discussion", "discussion and results"), "DISCUSSION").when(s.isin("conclusion", "conclusions"), "CONCLUSION")
        .when(s == "full text", "BODY_ANY").when(s == "abstract", "ABSTRACT").when(s == "title", "TITLE").otherwise("UNKNOWN")
    )


def section_bucket(c: Column | str) -> Column:
    """The group of a section by words that its name has."""
    s = F.lower(F.coalesce(col(c), F.lit("")))
    has = lambda w: F.contains(s, F.lit(w))
    return (
        F.when(has("result") & has("discussion"), "results_and_discussion").when(has("result"), "results").when(has("discussion"), "discussion").when(has("abstract"), "abstract")
        .when(has("introduction"), "introduction").when(has("reference") | has("bibliograph"), "references").when(has("author"), "author").when(has("title"), "title").otherwise("other")
    )


def section_priority(c: Column | str) -> Column:
    b = section_bucket(c)
    return F.when(b == "results_and_discussion", 0).when(b == "results", 1).when(b == "discussion", 2).when(b == "abstract", 3).when(b == "introduction", 4).otherwise(5)


def six(c: Column | str) -> Column:
    """Rounded to six places; the small addition keeps halves, which sums of short decimals often are, from falling either way."""
    return F.round(col(c) + 1e-9, 6)


def unit_score(c: Column) -> Column:
    """A score in 0..1 as it is, any other by the logistic curve (so 1.01 is less than 1)."""
    return F.when(c.between(0.0, 1.0), c).otherwise(1.0 / (1.0 + F.exp(-c)))


def fifth_score(c: Column) -> Column:
    """A score in 0..1 as it is, any other divided by five and kept in 0..1."""
    return F.when(c.between(0.0, 1.0), c).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / 5.0)))


def page_or_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(-1))


def numbers_and_units(c: Column | str) -> Column:
    """Distinct numbers with their unit, lower-cased, without spaces."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(edges(r"[0-9]+(?:\.[0-9]+)? ?(?:%|g/l|mg/l|mg|mm|um|fold|h\b)?")), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit(""))))


def facts(c: Column | str, least: int = 12) -> Column:
    """Sentences of at least ``least`` characters."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[.;!?\n。；！？]+"), lambda p: F.btrim(p))
    return F.filter(parts, lambda s: F.char_length(s) >= least)


def sentences(c: Column | str, least: int = 24, most: int = 80) -> Column:
    """Up to ``most`` sentences of ``least`` characters or more, split after end marks that white space follows and at semicolons, long ones into
    clauses; the limit is part of the feature."""
    flat = F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), WHITE, " "))
    pieces = F.filter(F.transform(F.split(F.regexp_replace(flat, r"([.!?。！？]) |[；;] ?", "$1\u0001"), "\u0001"), lambda p: F.btrim(p, F.lit(" ;；"))), lambda p: p != "")
    return F.slice(F.filter(F.flatten(F.transform(pieces, lambda p: clauses(p))), lambda s: F.char_length(s) >= least), 1, most)


def unbroken(c: Column | str) -> Column:
    """Words hyphenated over a line end are joined, single line ends become spaces, blank lines stay."""
    c = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"([a-z])-\n([a-z])", "$1$2")
    c = F.regexp_replace(c, r"\n[ \t]*\n+", "\u0001")
    return F.replace(F.regexp_replace(c, r"[ \t]*\n[ \t]*", " "), F.lit("\u0001"), F.lit("\n\n"))


def before_references(c: Column | str) -> Column:
    """The text up to a line that only says References or Bibliography."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)(^|\n)[ \t#]*(references|bibliography)[ \t]*\n.*$", "")


def first_json(c: Column | str) -> Column:
    """The text from the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 if one is null, empty, zero or of another length."""
    a, b = col(a), col(b)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    square = lambda x: total(F.transform(x, lambda v: v * v))
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (square(a) > 0) & (square(b) > 0)
    return F.when(fine, dot / (F.sqrt(square(a)) * F.sqrt(square(b)))).otherwise(0.0)


def letter_vector(c: Column | str) -> Column:
    """A deterministic stand-in for an embedding: the counts of a to z."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    n = F.octet_length(low)  # a letter is one byte, and bytes needn't be counted
    return F.array(*[(n - F.octet_length(F.replace(low, F.lit(chr(97 + i)), F.lit("")))).cast("double") for i in range(26)])


def canonical(c: Column | str, names: dict[str, list[str]]) -> Column:
    """The normal form with each name's other forms in its place, the longest first, so that no form is cut by a shorter one."""
    out = normal(c)
    for form, name in sorted(((f, n) for n, forms in names.items() for f in forms), key=lambda x: (-len(x[0]), x[0])):
        out = F.replace(out, F.lit(form), F.lit(name))
    return out


def keyword_variants(keyword: Column | str) -> Column:
    """The forms by which a keyword is looked for: normal, compact, without apostrophes."""
    n = normal(keyword)
    return F.array_distinct(F.filter(F.array(n, compact(keyword), F.replace(n, F.lit("'"), F.lit(""))), lambda v: v != ""))


def keyword_hits(c: Column | str, keywords: Column | str) -> Column:
    """Those of an array of keywords that the text has in some form."""
    forms = F.array(normal(c), compact(c), F.replace(normal(c), F.lit("'"), F.lit("")))
    return F.filter(F.coalesce(col(keywords), F.array().cast("array<string>")), lambda k: F.exists(keyword_variants(k), lambda v: F.exists(forms, lambda f: F.contains(f, v))))


def meets_keywords(c: Column | str, keywords: Column | str, part: float = 0.75) -> Column:
    """Whether the text has at least ``part`` of the keywords, rounded up; true if there are none."""
    return F.size(keyword_hits(c, keywords)) >= F.ceil(F.size(F.coalesce(col(keywords), F.array().cast("array<string>"))) * part)


def split_captions(c: Column | str) -> Column:
    """A paragraph as array<struct<kind, text>>: what comes before an inline caption, and each caption up to the next."""
    marked = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?<=[.!?] )(?=(?:Figure|Fig\.|Table) ?[A-Z]?\d+[.:|])", "\u0001")
    kind = lambda p: F.when(p.rlike(r"^(Figure|Fig\.) ?[A-Z]?\d+"), "figure_caption").when(p.rlike(r"^Table ?[A-Z]?\d+"), "table_caption").otherwise("paragraph")
    parts = F.filter(F.transform(F.split(marked, "\u0001"), lambda p: F.btrim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), p.alias("text")))


def section_name(c: Column | str) -> Column:
    """The usual section that a heading names, numbered or marked or not; null for another heading."""
    s = F.lower(F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^[#\s]*(\d+(\.\d+)*\.?)?\s*|[:.\s]+$", "")))
    names = {
        "Abstract": r"^(abstract|summary|摘要)$", "Introduction": r"^(introduction|引言|前言)$", "Background": r"^background$", "Results and Discussion": r"^results? and discussions?$", "Methods": r"^(materials? and methods?|methods?|experimental( section| procedures?)?|材料与方法)$",
        "Results": r"^(results?|findings|结果)$", "Discussion": r"^(discussions?|讨论)$", "Conclusion": r"^(conclusions?|concluding remarks|结论)$", "Acknowledgements": r"^acknowledge?ments?$", "References": r"^(references|bibliography|literature cited|参考文献)$",
    }
    out = F.lit(None).cast("string")
    for name, pattern in reversed(names.items()):
        out = F.when(s.rlike(pattern), name).otherwise(out)
    return out


# The forms in which a question names two branches, in the order in which they are tried, and what is cut from a branch.
BRANCH_FORMS = (
    r"一类[是为]\s*(.+?)，\s*另一类[是为]\s*(.+?)(?:$|[？?。])", r"一种[是为]\s*(.+?)，\s*另一种[是为]\s*(.+?)(?:$|[？?。])",
    r"^(?:请)?(?:比较|对比)\s*(?:文库中|当前文库中)?\s*(.+?)\s*[和与]\s*(.+?)\s*两(?:种|类|项)(?:[^？?。.]*)[？?。.]?$",
    r"^(?:请)?(?:比较|对比)\s*(?:文库中|当前文库中)?\s*(.+?)\s*[和与]\s*(.+?)\s*(?:之间的)?(?:异同|差异|区别|比较)(?:$|[？?。.,，])",
    r"比较\s+(.+?)\s+[和与]\s+(.+?)(?:的|在|有何|有什么|差异|区别|作用|机制|用途|角色|$|[？?。.,，])",
    r"(?i)(.+?)\s+vs\.?\s+(.+?)(?:$|[？?。.,，])", r"(?i)compare\s+(.+?)\s+and\s+(.+?)(?:$|[?.。,，])", r"(?i)comparison between\s+(.+?)\s+and\s+(.+?)(?:$|[?.。,，])", r"分别是\s+(.+?)\s+[和与]\s+(.+?)(?:$|[？?。.,，])",
)
BRANCH_CUTS = (
    r"(?i)^(比较|对比|请比较|请对比|文库中|当前文库中|当前知识库中|文库里)\s*", r"^(其中|分别|一类|另一类|一种|另一种)\s*", r"(?:两(?:种|类|项).{0,20}?(?:策略|研究|效应|方法|方案)|的异同|的差异|的区别|之间的差异|之间的异同|的比较)$", r"的$",
    r"(?i)^(compare|comparison between)\s+", r"(的两种角色|的两类角色|的角色|的策略|的机制|的作用|的用途)$",
)
BRANCH_EDGE = " ，,：:；;。."
COMPARING = r"(?i)\bvs\.?\b|\bcompare\b|\bcomparison\b|比较|对比|异同|差异|区别|两种|两类|两项|一类|另一类|一种|另一种"


def branch_name(c: Column) -> Column:
    """A branch without what introduces or closes it."""
    c = F.btrim(c, F.lit(BRANCH_EDGE))
    for cut in BRANCH_CUTS:
        c = F.btrim(F.regexp_replace(c, cut, ""), F.lit(BRANCH_EDGE))
    return c


def branch_problem(c: Column, generic: tuple[str, ...]) -> Column:
    """Why a branch is none: empty_branch, generic_branch, branch_too_long, branch_too_short; else null."""
    low = F.lower(F.btrim(c))
    parts = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+|[一-鿿]+"), F.lit(0))
    return (
        F.when(low == "", "empty_branch").when(low.isin(*generic), "generic_branch").when((F.char_length(c) > 80) | (F.octet_length(low) > 120), "branch_too_long")
        .when(low.rlike(r"^[a-z0-9_.-]{1,4}$"), None).when(F.char_length(F.array_join(parts, "")) < 2, "branch_too_short").when(F.forall(parts, lambda t: t.isin(*generic)), "generic_branch")
    )


def branches(question: Column | str, lexicon: Lexicon = Lexicon()) -> Column:  # noqa: B008
    """struct<left, right, reason> of a question that compares two things: the first form that gives two good branches. reason is ok, or
    why there is no pair: empty_question, not_comparison_intent, what is wrong with the first form that fits, or no_supported_pattern."""
    q = F.btrim(F.btrim(F.regexp_replace(F.coalesce(col(question), F.lit("")), WHITE, " ")), F.lit("？?。."))

    def pair(form: str) -> Column:
        left, right = (branch_name(F.regexp_extract(q, form, i)) for i in (1, 2))
        why = F.when((left == "") | (right == ""), "empty_branch").when(left == right, "duplicate_branch")
        return F.when(q.rlike(form), F.struct(left.alias("left"), right.alias("right"), F.coalesce(why, branch_problem(left, lexicon.generic_branches), branch_problem(right, lexicon.generic_branches), F.lit("ok")).alias("reason")))

    tried = F.array_compact(F.array(*map(pair, BRANCH_FORMS)))
    good = F.filter(tried, lambda p: p["reason"] == "ok")
    refused = lambda why: F.struct(F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"), why.alias("reason"))
    return (
        F.when(q == "", refused(F.lit("empty_question"))).when(~q.rlike(edges(COMPARING)), refused(F.lit("not_comparison_intent"))).when(F.size(good) > 0, F.get(good, F.lit(0)))
        .when(F.size(tried) > 0, refused(F.get(tried, F.lit(0))["reason"])).otherwise(refused(F.lit("no_supported_pattern")))
    )


def claims_any(c: Column | str, claims: tuple[str, ...], negations: tuple[str, ...], reach: int = 8) -> Column:
    """Whether the text has one of the claims, in any case, without a negation in the ``reach`` characters before it."""
    low = F.lower(F.coalesce(col(c), F.lit("")))

    def bare(claim: Column) -> Column:
        pieces = F.split(low, F.concat(F.lit("\\Q"), claim, F.lit("\\E")), -1)
        return F.exists(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: ~has_any(F.when(F.char_length(p) > reach, F.substr(p, F.char_length(p) - (reach - 1))).otherwise(p), negations))

    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x.lower())) & bare(F.lit(x.lower())) for x in claims], F.lit(False))


# Units of numbers in facts, forms of entities.
UNITS = r"%|g/l/h|g/l|mg/l|mg|mmol|mm|um|umol|nm|fold|h|hr|hours?|times?|x"
ENTITY = r"\b[a-z]{1,8}\d{1,5}[a-z0-9-]*\b|\b[a-z0-9]+(?:_[a-z0-9]+)+\b|\b[a-z]{2,18}ase\b|\b(?:abc|mfs|rnd|smr|mate|neu5ac|hsa|bge)\b"
CJK_ENTITY = r"[一-鿿]{2,}(?:酶|酸|菌|家族|转运体|转运蛋白|通道|泵|系统)"


def plain_number(c: Column) -> Column:
    """A number without zeros that say nothing: 05.50 is 5.5."""
    c = F.regexp_replace(c, r"^0+(?=\d)", "")
    return F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.?0*$", "")).otherwise(c)


def plain_unit(c: Column) -> Column:
    return F.when(c.isin("hr", "hour", "hours"), "h").when(c.isin("time", "times", "x"), "fold").otherwise(c)


def number_anchors(c: Column | str) -> Column:
    """Sorted distinct numbers with their units in plain form; of a range (3-5 g/l, 3 to 5 g/l) both ends with the unit, and the range."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    number, ranges = r"(\d+(?:\.\d+)?)", edges(rf"\b(\d+(?:\.\d+)?)\s*(?:-|~|to)\s*(\d+(?:\.\d+)?)\s*({UNITS})(?![a-z0-9])")
    part = lambda x, form, i: F.regexp_extract(x, form, i)

    def ends(x: Column) -> Column:
        a, b, u = plain_number(part(x, ranges, 1)), plain_number(part(x, ranges, 2)), plain_unit(part(x, ranges, 3))
        return F.array(F.concat(a, u), F.concat(b, u), F.concat(a, F.lit("-"), b, u))

    single = edges(rf"\b{number}(?:\s*({UNITS})(?![a-z0-9]))?")
    spans = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(ranges), F.lit(0)), ends))
    alone = F.transform(F.regexp_extract_all(low, F.lit(single), F.lit(0)), lambda x: F.concat(plain_number(part(x, single, 1)), plain_unit(part(x, single, 2))))
    return F.array_sort(F.array_distinct(F.concat(spans, alone)))


def entities(c: Column | str) -> Column:
    """Sorted distinct names of enzymes, genes, compounds and systems by their form."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(edges(ENTITY)), F.lit(0)), F.regexp_extract_all(low, F.lit(CJK_ENTITY), F.lit(0)))))


def clauses(c: Column | str, whole: int = 360, most: int = 300) -> Column:
    """A sentence as it is, or, above ``whole`` characters, its clauses joined again up to ``most`` characters a piece: a fold in the JVM."""
    c = F.coalesce(col(c), F.lit(""))
    parts = F.filter(F.transform(F.split(c, r"(?<=,)\s+|，\s*"), lambda p: F.btrim(p, F.lit(" ,，"))), lambda p: p != "")

    def put(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last, F.lit("，"), p)
        fits = (F.size(acc) > 0) & (F.char_length(joined) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(p)))

    return F.when(F.char_length(c) <= whole, F.array(c)).otherwise(F.aggregate(parts, F.array().cast("array<string>"), put))
