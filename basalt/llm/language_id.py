"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: a naive Bayes model over hashed byte trigrams, fitted on a bounded sample of rows whose
  declared language is one of ``languages`` (``sample`` rows a language, those of smallest hash of
  id). One more class, ``und``, spreads its mass evenly, so text unlike every language falls to it.
* Declared language: P(declared | language), from the text posteriors summed by declared value.
* Address suffix and host: priors smoothed root -> suffix -> host, again sums of text posteriors by
  group, each row's own share taken out of its host's.
The sums cover every row; only group tables, never rows, meet in an aggregation.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm._scratch import Scratch
from basalt.llm._words import utf8

BUCKETS = 1 << 15
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


_hidden = re.compile(r"<!--.*?-->|<(script|style|noscript|template|nav)\b.*?</\1\s*>", re.I | re.S)
_tag = re.compile(r"<[^>]*>")
_html = re.compile(r"<html\b[^>]*>", re.I)
_lang = re.compile(r"""[\s"'](?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,8})""", re.I)
_meta = re.compile(r"""<meta\b(?=[^>]*http-equiv\s*=\s*["']?content-language)[^>]*\bcontent\s*=\s*["']?\s*([A-Za-z]{2,8})""", re.I)


def markup(page: str | None) -> tuple[str | None, str | None]:
    """(text, declared language) of a page: without tags, scripts, styles and menus; the primary
    subtag of ``<html lang>`` or else of a Content-Language meta element, in lower case."""
    if page is None:
        return None, None
    head = _hidden.sub(" ", page)
    root = _html.search(head)
    found = (root and _lang.search(root.group())) or _meta.search(head)
    return entities.unescape(_tag.sub(" ", head)), found.group(1).lower() if found else None


def address(url: str | None) -> tuple[str | None, str | None]:
    """(host, suffix) of an address; the suffix is the host's last label, none for a number."""
    try:
        host = (urlsplit((url or "").strip()).hostname or "").rstrip(".")
    except ValueError:
        host = ""
    suffix = host.rsplit(".", 1)[-1] if "." in host and ":" not in host else ""
    return host or None, suffix if suffix and not suffix.isdigit() else None


def evidence(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, text, declared, host, suffix) of each page, for ``identify``; what is missing is null."""

    def run(batches):
        for batch in batches:
            texts = [markup(p) for p in batch.column(1).to_pylist()]
            places = [address(u) for u in batch.column(2).to_pylist()]
            cols = [[t for t, _ in texts], [d for _, d in texts], [h for h, _ in places], [s for _, s in places]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "text", "declared", "host", "suffix"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, text string, declared string, host string, suffix string")


def identify_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", **options) -> DataFrame:
    """(page_id, language, posterior, accepted) for each page, from its text, markup and address."""
    found = evidence(pages, id_col, html_col, url_col)
    found = Scratch(pages.sparkSession, "page-evidence").table(found, "evidence")
    out = identify(found, id_col="page_id", declared_col="declared", host_col="host", suffix_col="suffix", **options)
    return out.withColumnRenamed("doc_id", "page_id")


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram of a text; trigrams that start and end in a non-letter are left out."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    b = _FOLD[data]
    keep = (b[:-2] != 32) | (b[1:-1] != 32) & (b[2:] != 32)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D))[keep]
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64)


def _per_text(column, fn):
    """fn(trigram buckets) of each text, summed over segments of a long one."""
    data, at = utf8(column)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        yield sum((fn(trigrams(data[s : min(s + (1 << 20) + 2, hi)])) for s in range(lo, max(hi - 2, lo + 1), 1 << 20)))


def _fit(docs: DataFrame, languages: tuple[str, ...], sample: int) -> np.ndarray:
    """log P(trigram | class), classes in the order of ``languages``, then ``und``."""
    usable = docs.where(F.col("declared").isin(*languages) & F.col("id").isNotNull()).select("id", "declared")
    # A bound on the hash leaves some twice ``sample`` rows a language, whatever their number, before any are sorted.
    about = {r.declared: r.n for r in usable.groupBy("declared").agg(F.approx_count_distinct("id").alias("n")).collect()}
    place = F.xxhash64("id")
    bound = lambda n: -(1 << 63) + min((1 << 64) - 1, (2 * sample + 1000) * (1 << 64) // max(n, 1))
    near = F.coalesce(*(F.when(F.col("declared") == d, place <= F.lit(bound(n))) for d, n in about.items()), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("declared").orderBy(place, "id"))
    chosen = usable.where(near).distinct().withColumn("r", rank).where(F.col("r") <= sample).select("id", "declared")
    # At most ``sample`` ids a language, so they may be sent to every task; the texts stay where they are.
    texts = docs.join(F.broadcast(chosen), ["id", "declared"], "left_semi").select("text", "declared")

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for lang, n in zip(batch.column(1).to_pylist(), _per_text(batch.column(0), lambda c: np.bincount(c, minlength=BUCKETS))):
                total[languages.index(lang)] += n
        lang, bucket = np.nonzero(total)
        yield pa.record_batch([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    counts = np.full((len(languages) + 1, BUCKETS), 0.5)
    # At most languages x BUCKETS rows.
    for lang, bucket, n in texts.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n")).collect():
        counts[lang, bucket] += n
    counts[-1] = 1.0
    return np.log(counts / counts.sum(1, keepdims=True))


def identify(docs: DataFrame, languages: tuple[str, ...] = ("de", "en", "es", "fr"), id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", suffix_col: str | None = None, sample: int = 2000, temper: float = 1 / 3, smooth: float = 20.0, accept: float = 0.5) -> DataFrame:
    """(doc_id, language, posterior, accepted) for each row.

    ``temper`` weighs the (overlapping, hence dependent) trigrams, ``smooth`` is the strength of a
    parent prior. Text without a letter trigram has no language: ``und``, posterior 1, not accepted;
    so have null and empty texts. Null evidence counts as a value of its own. Ties go to the language
    that sorts first. Repeated rows each give a row. An empty table gives an empty result.
    """
    languages = tuple(sorted(languages))
    names = [*languages, UNKNOWN]
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lower(col(declared_col)).alias("declared"), col(suffix_col).alias("suffix"), col(host_col).alias("host"))
    table = _fit(rows, languages, sample).astype(np.float32)
    lls, ps = [f"l{i}" for i in range(len(names))], [f"p{i}" for i in range(len(names))]

    def score(batches):
        for batch in batches:
            found = list(_per_text(batch.column(1), lambda c: np.append(table[:, c].sum(1, dtype=np.float64), len(c))))
            x = np.array(found).reshape(batch.num_rows, -1)
            ll = x[:, :-1] * temper
            p = np.exp(ll - ll.max(1, keepdims=True)) if len(x) else ll
            p /= p.sum(1, keepdims=True)
            p *= (x[:, -1:] > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(x[:, -1].astype(np.int64)), *map(pa.array, ll.T.copy()), *map(pa.array, p.T.copy())], names=["id", "declared", "suffix", "host", "grams", *lls, *ps])

    work = Scratch(docs.sparkSession, "language-id")
    schema = "id long, declared string, suffix string, host string, grams long, " + ", ".join(f"{c} double" for c in lls + ps)
    scored = work.table(rows.mapInArrow(score, schema), "scored")

    sums = lambda df, *by: df.groupBy(*by).agg(*(F.sum(p).alias(p) for p in ps))
    renamed = lambda df, tag, *by: df.select(*by, *(F.col(p).alias(f"{tag}{i}") for i, p in enumerate(ps)))
    total = lambda tag: sum((F.col(f"{tag}{i}") for i in range(1, len(names))), F.col(f"{tag}0"))
    hosts = work.table(sums(scored, "suffix", "host"), "hosts")
    suffixes = renamed(sums(hosts, "suffix"), "s", "suffix")
    root = renamed(sums(hosts), "g")
    priors = renamed(hosts, "h", "suffix", "host").join(suffixes, "suffix").crossJoin(F.broadcast(root))  # root: one row
    parent = lambda i: (F.col(f"s{i}") + smooth * (F.col(f"g{i}") + 1) / (total("g") + len(names))) / (total("s") + smooth)
    priors = priors.select("suffix", "host", *(F.col(f"h{i}") for i in range(len(names))), *(parent(i).alias(f"q{i}") for i in range(len(names))))
    declared = sums(scored, "declared")
    declared = renamed(declared, "d", "declared").crossJoin(F.broadcast(root)).select("declared", *((F.log((F.col(f"d{i}") + 0.5) / (F.col(f"g{i}") + 1))).alias(f"e{i}") for i in range(len(names))))

    fused = scored.join(work.table(priors, "priors"), ["suffix", "host"]).join(work.table(declared, "declared"), "declared")
    own = lambda i: F.greatest(F.col(f"h{i}") - F.col(f"p{i}"), F.lit(0.0))
    others = sum((own(i) for i in range(1, len(names))), own(0))
    fused = fused.select("id", "grams", *(((F.col(f"l{i}") + F.col(f"e{i}") + F.log((own(i) + smooth * F.col(f"q{i}")) / (others + smooth)))).alias(f"z{i}") for i in range(len(names))))
    zs = [F.col(f"z{i}") for i in range(len(names))]
    best = F.greatest(*zs)
    pick = F.coalesce(*(F.when(z == best, F.lit(n)) for z, n in zip(zs, names)))
    mass = sum((F.exp(z - best) for z in zs[1:]), F.exp(zs[0] - best))
    out = fused.select(F.col("id").alias("doc_id"), F.when(F.col("grams") > 0, pick).otherwise(F.lit(UNKNOWN)).alias("language"), F.when(F.col("grams") > 0, 1 / mass).otherwise(F.lit(1.0)).alias("posterior"))
    return out.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= accept))
