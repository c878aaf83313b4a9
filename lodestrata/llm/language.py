"""Language identification of pages by Bayesian evidence fusion.

Four pieces of evidence meet in one posterior for each page: the likelihood of
its visible text under byte-trigram models, the language that the markup
declares, the language that the address names (a path segment, or the country
suffix of the host), and a prior of its host. How far declarations and addresses
can be trusted, and the priors, come from grouped aggregations of the text
posteriors over all pages; priors are smoothed from host to registered domain to
suffix to all pages, and a page's own share is taken out of its host's counts.

The trigram models are fitted on a bounded sample: SAMPLE labelled documents of
each language, those of the smallest key hashes. Every page is judged on its
whole text, whatever its length.

Defined results: a null address or page gives no such evidence; a page without
any takes the prior of all pages. Repeated rows each get a row and each count;
equally likely languages go by name. Labelled documents without key or text teach
nothing; without labelled documents the language is null. An empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import store, words

SAMPLE = 1000
#: Trigrams of one text are far from independent: n of them weigh as n ** GROWTH.
GROWTH = 0.8
#: Pages' worth of the level above in each level's prior.
PRIOR = 4.0
_BUCKETS = 1 << 16

_HIDDEN = re.compile(r"<script.*?(?:</script>|\Z)|<style.*?(?:</style>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)
# The attributes of each <html ...> outside scripts, styles and comments. Nothing follows them, so a page is gone through once.
_ROOT = re.compile(r"""<script.*?(?:</script>|\Z)|<style.*?(?:</style>|\Z)|<!--.*?(?:-->|\Z)|<html\b((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)""", re.S | re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I)
_ADDRESS = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", re.I)

_letters = np.full(256, 32, np.uint8)
for _b in [*range(97, 123), *range(128, 256)]:
    _letters[_b] = _b
_letters[65:91] = np.arange(97, 123)


def visible(page: str) -> str:
    """The text of a page without scripts, styles, comments and tags."""
    return html.unescape(_HIDDEN.sub(" ", page))


def declaration(page: str) -> str:
    """The language code that the markup of the whole page declares, or ''."""
    for root in _ROOT.finditer(page):
        if root[1] and (m := _LANG.search(root[1])):
            return m[1][:2].lower()
    return ""


def address(url: str) -> tuple[str, str, str, str]:
    """(host, registered domain, suffix, language code of the address or '')."""
    m = _ADDRESS.match(url)
    if not m:
        return "", "", "", ""
    host = m[1].rpartition("@")[2].partition(":")[0].lower().strip(".")
    labels = host.split(".")
    codes = [x.lower() for x in m[2].split("/") if re.fullmatch(r"[A-Za-z]{2}(-[A-Za-z]{2})?", x)]
    suffix = labels[-1] if len(labels) > 1 else ""
    return host, ".".join(labels[-2:]), suffix, codes[0][:2] if codes else suffix if len(suffix) == 2 else ""


def trigrams(column: pa.Array):
    """(first row, end row, trigram buckets, first of each row + total), by chunks of a text column."""
    data, offsets = store.utf8(column)
    for a, b in store.chunks(offsets, 1 << 20):
        own = offsets[a : b + 1] - offsets[a]
        x = _letters[data[offsets[a] : offsets[b]]].astype(np.uint32)
        row_end = np.repeat(own[1:], np.diff(own))
        g = np.zeros(len(x), np.uint32)
        if len(x) > 2:
            g[:-2] = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        valid = np.arange(len(x)) + 2 < row_end
        if len(x) > 2:
            valid[:-2] &= ~((x[:-2] == 32) & (x[1:-1] == 32))
        at = np.concatenate(([0], np.cumsum(valid)))
        yield a, b, (g[valid] >> np.uint32(16)).astype(np.int64), at[own]


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # log-probabilities, language by bucket

    def likelihoods(self, column: pa.Array) -> np.ndarray:
        """(rows x languages) tempered log-likelihoods."""
        out = np.zeros((len(column), len(self.languages)))
        for a, b, g, first in trigrams(column):
            n = np.diff(first)
            full = np.flatnonzero(n)
            if len(full):
                for k, row in enumerate(self.table):
                    out[a + full, k] = np.add.reduceat(row[g], first[:-1][full]) / n[full]
            out[a:b] *= (n.astype(float) ** GROWTH)[:, None]
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> TextModel:
    """Trigram models of the documents' labelled languages."""
    own = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    # one pass over keys and labels; each task passes on at most `sample` rows a language
    first = Window.partitionBy(lang).orderBy(F.xxhash64(key), key)
    chosen = own.select(key, lang).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= sample).drop("_r").distinct()
    chosen = store.kept(chosen, "language-keys")
    languages = sorted(r[0] for r in chosen.select(lang).distinct().collect())
    if not languages:
        return TextModel([], np.zeros((0, _BUCKETS)))
    place = {x: k for k, x in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), _BUCKETS), np.int64)
        for batch in batches:
            rows = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()])
            for a, b, g, first in trigrams(batch.column(0)):
                for k in range(len(languages)):
                    mine = np.repeat(rows[a:b] == k, np.diff(first))
                    total[k] += np.bincount(g[mine], minlength=_BUCKETS)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"l": at[0], "b": at[1], "n": total[at]})

    # `sample` rows a language are read here, and 65,536 counts a language come back
    rows = store.kept(own.select(key, text, lang).join(F.broadcast(chosen), [key, lang]).select(text, lang), "language-sample")
    counts = rows.mapInArrow(count, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), _BUCKETS), 0.05)
    table[counts["l"].to_numpy(), counts["b"].to_numpy()] += counts["n"].to_numpy()
    return TextModel(languages, np.log(table / table.sum(1, keepdims=True)))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def identify(pages: DataFrame, model: TextModel, page: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, declared, addressed, text_lang, lang, probability) of every page."""
    kind = pages.select(key).schema.fields[0].dataType.simpleString()
    languages, known = model.languages, set(model.languages)
    n = len(languages)
    if not n:
        none = F.lit(None).cast("string")
        return pages.select(key, *[none.alias(c) for c in ("host", "declared", "addressed", "text_lang", "lang")], F.lit(None).cast("double").alias("probability"))
    shares = [f"p{k}" for k in range(n)]

    def read(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                raw = [x or "" for x in part.column(2).to_pylist()]
                places = [address(x or "") for x in part.column(1).to_pylist()]
                declared = [declaration(x) for x in raw]
                score = model.likelihoods(pa.array([visible(x) for x in raw], pa.string()))
                columns = [part.column(0), *(pa.array([p[j] for p in places], pa.string()) for j in range(3))]
                columns += [pa.array([x if x in known or not x else "other" for x in c], pa.string()) for c in (declared, [p[3] for p in places])]
                columns += [pa.array(s, pa.float64()) for s in (*_softmax(score).T, *score.T)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "host", "domain", "suffix", "declared", "addressed", *shares, *(f"l{j}" for j in range(n))])

    fields = ", ".join([f"`{key}` {kind}", "host string, domain string, suffix string, declared string, addressed string", *(f"{c} double" for c in shares), *(f"l{k} double" for k in range(n))])
    seen = store.kept(pages.select(key, url, page).mapInArrow(read, fields), "page-evidence")

    def totals(by):  # bounded: languages + 2 values
        sums = {r[by]: np.array(r[1:], float) for r in seen.groupBy(by).agg(*[F.sum(c) for c in shares]).collect()}
        return {v: np.log((s + 0.5) / (sum(sums.values()) + 0.5 * (n + 2))) for v, s in sums.items()}

    trust = {c: totals(c) for c in ("declared", "addressed")}
    everywhere = np.array(seen.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in shares]).first(), float) + 0.5
    everywhere /= everywhere.sum()
    # a host has one domain and one suffix, so the sums of all levels stand beside it and pages are joined once
    hosts = store.kept(seen.groupBy("host", "domain", "suffix").agg(*[F.sum(c).alias(f"host_{c}") for c in shares]), "host-shares")
    for level in ("suffix", "domain"):
        hosts = hosts.join(hosts.groupBy(level).agg(*[F.sum(f"host_{c}").alias(f"{level}_{c}") for c in shares]), level)
    joined = seen.join(hosts.drop("domain", "suffix"), "host")

    def fuse(batches):
        for batch in batches:
            get = lambda names: np.stack([batch.column(c).to_numpy() for c in names], 1)
            own, logit = get(shares), get([f"l{k}" for k in range(n)])
            text = logit.argmax(1)
            none = np.abs(logit).sum(1) == 0
            prior = np.repeat(everywhere[None, :], batch.num_rows, 0)
            for level in ("suffix", "domain", "host"):
                rest = np.maximum(get([f"{level}_{c}" for c in shares]) - own, 0)
                prior = (rest + PRIOR * prior) / (rest.sum(1, keepdims=True) + PRIOR)
            logit = logit + np.log(prior)
            for c in ("declared", "addressed"):
                values = batch.column(c).to_pylist()
                logit += np.array([trust[c][v] if v else np.zeros(n) for v in values]).reshape(-1, n)
            p = _softmax(logit)
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), batch.column("host"), batch.column("declared"), batch.column("addressed"),
                    pa.array([None if z else languages[k] for k, z in zip(text, none)], pa.string()), pa.array([languages[k] for k in best]), pa.array(p[np.arange(len(best)), best]),
                ],
                names=[key, "host", "declared", "addressed", "text_lang", "lang", "probability"],
            )

    return joined.mapInArrow(fuse, f"`{key}` {kind}, host string, declared string, addressed string, text_lang string, lang string, probability double")
