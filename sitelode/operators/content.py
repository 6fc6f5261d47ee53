"""Stored pages: fields, links, reachability over the link table, language."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitelode.functions.layout import top_per_group
from sitelode.functions.scalars import as_col, one_of, words
from sitelode.session import scratch_path

PAGES_PER_SITE = 50
LETTERS = r"\p{L}+"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)"

# --- fixed values: frequent words per language -------------------------------------
LANGUAGE_WORDS: Mapping[str, tuple[str, ...]] = {
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht", "ein", "eine", "als"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "this", "are"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "pas", "au"),
}


def host_of(url: Column | str) -> Column:
    """Lower-case host of a URL; null when there is none.

    A pattern rather than `try_parse_url`: over twice as fast, and a stray
    character later in the URL does not lose the host.
    """
    host = F.regexp_extract(as_col(url), URL_HOST, 1)
    return F.lower(F.nullif(host, F.lit("")))


# --- fixed values: entities that pages hold most; `amp` last, so nothing is decoded twice
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
    ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"),
)
QUOTED = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: One piece of markup after the other: a comment, a script, style or title with its content, a tag whose quoted attributes
#: may hold `>`, a tag with stray quotes, a run of text, a `<` that opens nothing.
MARKUP = (
    r"(?is)<!--.*?-->|<(script|style|title)\b[^>]*+>.*?</\1\s*>"
    r"""|<[!/?]?[a-z](?:[^"'>]++|"[^"]*"|'[^']*')*+>|<[!/?]?[a-z][^>]*+>|[^<]++|<"""
)


def decoded(text: Column) -> Column:
    """Common HTML entities as characters."""
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def markup(html: Column) -> Column:
    """The pieces of a page in order, found in one pass: see MARKUP. Null stays null."""
    return F.regexp_extract_all(html, F.lit(MARKUP), F.lit(0))


def _tags(pieces: Column, name: str) -> Column:
    """The opening tags of one name; what a comment, script or style holds is part of that piece and no tag."""
    return F.filter(pieces, lambda t: (F.lower(F.substring(t, 1, len(name) + 1)) == f"<{name}") & ~F.substring(t, len(name) + 2, 1).rlike("[A-Za-z0-9-]"))


def _raw_attribute(tag: Column, name: str) -> Column:
    """An attribute's value with its quotes, '' when there is none: attributes are read in order, so no value is taken for a name."""
    gap = r"""(?:[\s/]+|(?<=["']))"""
    other = rf"""{gap}[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
    return F.regexp_extract(tag, rf"(?is)^<[a-z][a-z0-9-]*(?:{other})*?{gap}{name}\s*=\s*{QUOTED}", 1)


def _unquoted(value: Column) -> Column:
    """An attribute value without its quotes; '' when there was none."""
    return decoded(F.regexp_replace(value, r"""^["']|["']$""", ""))


def _attribute(tag: Column, name: str) -> Column:
    return _unquoted(_raw_attribute(tag, name))


def page_extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Replace stored HTML by host, title, description, declared language and visible text.

    All five come from one list of markup pieces, so nothing is read out of comments, scripts and styles, and a `>` inside
    a quoted attribute ends no tag. Attributes may be quoted either way or not at all; common entities are decoded. The
    first title, the first description and the first html tag count. Missing or empty values are null, a null page has a null text.
    """
    pieces = F.col("_pieces")
    title = F.regexp_extract(F.get(_tags(pieces, "title"), F.lit(0)), r"(?is)^<title[^>]*>(.*)</title\s*>$", 1)
    lang = _attribute(F.get(_tags(pieces, "html"), F.lit(0)), "lang")
    described = F.filter(_tags(pieces, "meta"), lambda m: F.lower(_attribute(m, "name")) == "description")
    description = F.trim(_attribute(F.get(described, F.lit(0)), "content"))
    shown = F.transform(pieces, lambda t: F.when(F.startswith(t, F.lit("<")) & (F.length(t) > 1), F.lit(" ")).otherwise(t))
    text = F.trim(F.regexp_replace(decoded(F.array_join(shown, "")), r"\s+", " "))
    rest = [c for c in pages.columns if c != html]
    return pages.withColumn("_pieces", markup(F.col(html))).select(
        *rest,
        host_of(url).alias("host"),
        F.nullif(F.trim(decoded(title)), F.lit("")).alias("title"),
        F.nullif(description, F.lit("")).alias("description"),
        F.nullif(lang, F.lit("")).alias("language"),
        text.alias("visible_text"),
    )


def _without_dots(path: Column) -> Column:
    """A path with its `.` and `..` segments resolved."""
    parts = F.split(path, "/")
    dot = lambda s: (s == ".") | (s == "..")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(F.when(dot(F.element_at(parts, -1)), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def _address_parts(address: Column) -> Column:
    """What links are resolved against, once per page: scheme, scheme with host, the page without query, its folder."""
    page = F.regexp_replace(address, r"[?#].*$", "")
    folder = F.regexp_replace(page, r"(://[^/]+.*/)[^/]*$", "$1")
    return F.struct(
        F.regexp_extract(address, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1).alias("scheme"),
        F.regexp_extract(address, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1).alias("root"),
        page.alias("page"),
        F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")).alias("folder"),
    )


def _joined(at: Column, link: Column) -> Column:
    """A link made absolute against the address parts `at`; dot segments are left."""
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(at["scheme"], link))
        .when(link.startswith("/"), F.concat(at["root"], link))
        .when(link.startswith("?"), F.concat(at["page"], link))
        .otherwise(F.concat(at["folder"], link))
    )


def _undotted(address: Column) -> Column:
    """An address without dot segments; only one with a dot after a slash is taken apart."""
    cut = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$"
    start, path, tail = (F.regexp_extract(address, cut, i) for i in (1, 2, 3))
    dotted = path.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(F.contains(address, F.lit("/.")), F.when(dotted, F.concat(start, _without_dots(path), tail)).otherwise(address)).otherwise(address)


def link_extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, position, link): anchors of each page, made absolute against its address or its `<base>`.

    `position` numbers the anchors with an `href` from 0 in page order; links that are then dropped leave a gap. Dropped are
    empty links, fragments and schemes other than http and https. All quote forms count, anchors inside comments, scripts
    and styles do not (see `markup`); common entities are decoded, `.` and `..` resolved.
    """
    hrefs = F.filter(F.transform(_tags(F.col("_pieces"), "a"), lambda t: _raw_attribute(t, "href")), lambda h: h != "")
    taken = pages.select(key, F.col(url).alias("_url"), markup(F.col(html)).alias("_pieces")).select(
        key, "_url", hrefs.alias("_hrefs"), F.coalesce(_attribute(F.get(_tags(F.col("_pieces"), "base"), F.lit(0)), "href"), F.lit("")).alias("_base")
    )
    based = taken.withColumn("_own", _address_parts(F.col("_url"))).withColumn(
        "_page", F.when(F.col("_base") == "", F.col("_url")).otherwise(_undotted(_joined(F.col("_own"), F.col("_base"))))
    )
    placed = based.select(key, _address_parts(F.col("_page")).alias("_at"), F.posexplode("_hrefs").alias("position", "_raw"))
    found = placed.select(key, "position", "_at", F.trim(_unquoted(F.col("_raw"))).alias("_href"))
    other = F.col("_href").rlike(r"(?i)^(?!https?:)[A-Za-z][A-Za-z0-9+.-]*:")
    wanted = found.filter((F.col("_href") != "") & ~F.col("_href").startswith("#") & ~other)
    joined = wanted.select(key, "position", _joined(F.col("_at"), F.col("_href")).alias("link"))
    return joined.select(key, "position", _undotted(F.col("link")).alias("link"))


def link_bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(node, depth): least number of links from any seed, up to `max_depth`.

    `edges` has (src, dst), `seeds` has (node). Every round is written to the
    shared folder as depth=<d> and the nodes seen so far are read back from
    there, so the plan does not grow and a lost executor repeats one round only.
    For many rounds give an edge table bucketed by `src`: it is then never shuffled.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "reach")
    kind = dict(seeds.dtypes)["node"]

    def reached() -> DataFrame:
        return spark.read.schema(f"node {kind}, depth int").parquet(root)

    seeds.select("node").filter(F.col("node").isNotNull()).distinct().write.parquet(f"{root}/depth=0")
    for depth in range(1, max_depth + 1):
        frontier = reached().filter(F.col("depth") == depth - 1).select(F.col("node").alias("src"))
        step = (
            edges.join(frontier, "src")
            .select(F.col("dst").cast(kind).alias("node"))
            .filter(F.col("node").isNotNull())
            .distinct()
            .join(reached().select("node"), "node", "left_anti")
        )
        step.write.parquet(f"{root}/depth={depth}")
        if reached().filter(F.col("depth") == depth).isEmpty():
            break
    return reached()


def page_cap(pages: DataFrame, host: str = "host", order: Sequence[str] = ("depth", "url"), cap: int = PAGES_PER_SITE) -> DataFrame:
    """At most `cap` pages per host, in `order`, with their rank."""
    return top_per_group(pages, [host], [F.asc(c) for c in order], cap)


def lang_detect(
    documents: DataFrame,
    text: str = "text",
    profile: Mapping[str, Sequence[str]] = LANGUAGE_WORDS,
    min_hits: int = 3,
) -> DataFrame:
    """Add `detected`: the language whose frequent words occur most, null below `min_hits`.

    Equal counts go to the lower language code. The profile is a small constant, so
    it is part of the expression: no join, no shuffle.
    """
    listed = sorted({w for ws in profile.values() for w in ws})
    hits = F.filter(words(text, LETTERS), lambda w: one_of(w, listed))

    def score(rank: int, lang: str) -> Column:
        n = F.size(F.filter("_hits", lambda w: one_of(w, profile[lang])))
        return F.struct(n.alias("hits"), F.lit(-rank).alias("order"), F.lit(lang).alias("lang"))

    scores = F.array(*[score(rank, lang) for rank, lang in enumerate(sorted(profile))])
    counted = documents.withColumn("_hits", hits).withColumn("_scores", scores)
    best = F.array_max("_scores")
    return counted.withColumn("detected", F.when(best["hits"] >= min_hits, best["lang"])).drop("_hits", "_scores")
