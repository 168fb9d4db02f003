"""Operator 5: language identification by Bayesian evidence fusion.

Four kinds of evidence are added up as log-odds: the words of the text under
each language's model, the language that the markup declares, the suffix of
the address, and a prior of the host.  The host's prior is smoothed towards its
domain's, that one towards the suffix's, and that one towards the whole
collection's, each by grouped counts over all documents.

Text model: counts of hashed words and of letter triples inside words, from a
sample of each known language's rows, bounded for each; everything else (the
list of languages, the priors) covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk

U64 = np.uint64
BUCKETS = 1 << 15
#: How much of the text's log-likelihood counts: neighbouring triples and words are not independent.
TEMPER = 0.05
#: Most that the text alone can say for or against a language, in natural log units.
LIMIT = 40.0


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray  # language x bucket, centred log-likelihoods


def text_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and letter triples, and how many of them come before each document's end."""
    low = tk.LOWER[data]
    is_letter = np.zeros(256, dtype=bool)
    is_letter[0x61:0x7B] = True
    is_letter[0x80:] = True
    starts, ends, counts = tk.word_bounds(low, offsets, is_letter)
    words = (tk.word_hashes(low, starts, ends) % U64(BUCKETS)).astype(np.int64)
    inside = is_letter[low]
    n = max(0, len(low) - 2)
    at = np.flatnonzero(inside[:n] & inside[1 : n + 1] & inside[2 : n + 2]) if n else np.zeros(0, dtype=np.int64)
    # a triple belongs to the document of its first byte; those across a border are left out
    owner = np.searchsorted(offsets, at, side="right") - 1
    keep = at + 2 < offsets[owner + 1]
    at, owner = at[keep], owner[keep]
    code = (low[at].astype(U64) << U64(16)) | (low[at + 1].astype(U64) << U64(8)) | low[at + 2].astype(U64)
    triples = (tk.mix(code) % U64(BUCKETS)).astype(np.int64)
    both = np.concatenate([words, triples])
    owners = np.concatenate([np.searchsorted(counts, np.arange(len(words)), side="right") - 1, owner])
    order = np.argsort(owners, kind="stable")
    return both[order], np.searchsorted(owners[order], np.arange(len(offsets)))


def fit_text(rows: list[tuple[str, str]], *, add: float = 0.5, languages: list[str] | None = None) -> TextModel:
    """rows: (text, language).  A language without rows has a flat likelihood; without ``languages`` those of the rows are taken."""
    languages = sorted({lang for _, lang in rows}) if languages is None else languages
    counts = np.zeros((len(languages), BUCKETS))
    data, offsets = tk.buffers(pa.array([t for t, _ in rows], pa.string()))
    buckets, bounds = text_buckets(data, offsets)
    for n, (_, lang) in enumerate(rows):
        counts[languages.index(lang)] += np.bincount(buckets[bounds[n] : bounds[n + 1]], minlength=BUCKETS)
    return _model(languages, counts, add)


def _model(languages: list[str], counts: np.ndarray, add: float = 0.5) -> TextModel:
    logs = np.log((counts + add) / (counts + add).sum(axis=1, keepdims=True))
    return TextModel(languages, logs - logs.mean(axis=0, keepdims=True) if len(languages) else logs)


def fit_sample(docs: DataFrame, *, lang: str, text: str, key: str, each: int = 500, longest: int = 65536, also: str | None = None) -> TextModel:
    """A model of all languages in ``lang`` (and ``also``), fitted on at most ``each`` rows of each, chosen by a hash.

    Texts of 200 bytes and more come first; a language with too few of them takes
    shorter ones.  Of a text of more than ``longest`` characters a stretch of that
    many, chosen by a hash, teaches.  Texts are counted in the tasks: only sums
    reach the driver.
    """
    size = F.octet_length("t")
    rows = docs.select(F.col(text).cast("string").alias("t"), F.nullif(lang, F.lit("")).alias("l"), F.nullif(also or lang, F.lit("")).alias("a"), F.col(key).alias("k"))
    good, other = size >= 200, (size > 0) & (size < 200)
    per = {}
    for r in rows.groupBy("l", "a").agg(F.count(F.when(good, 1)).alias("n"), F.count(F.when(other, 1)).alias("m")).collect():
        for code in (r["l"], r["a"]):
            if code is not None:
                per.setdefault(code, [0, 0])
        if r["l"] is not None:
            per[r["l"]][0] += r["n"]
            per[r["l"]][1] += r["m"]
    languages = sorted(per)
    # twice the rows wanted pass a bound on the hash (all of a small language); the smallest of them are taken
    share = lambda wanted, n: 1.0 if n <= 4 * wanted else 2 * wanted / n
    bounds = {c: (share(each, n), share(each - n, m) if n < each and m else 0.0) for c, (n, m) in per.items()}
    if not bounds:
        return _model([], np.zeros((0, BUCKETS)))
    of = lambda i: F.create_map(*(F.lit(x) for c, b in bounds.items() for x in (c, b[i])))[F.col("l")]
    place = F.pmod(F.xxhash64("k", "t"), F.lit(1 << 30)) / float(1 << 30)
    near = rows.where(F.col("l").isNotNull() & (good | other)).withColumn("o", (~good).cast("int")).where(place < F.when(F.col("o") == 0, of(0)).otherwise(of(1)))
    begin = F.when(F.length("t") > longest, F.pmod(F.xxhash64("k", "t"), F.length("t") - longest + 1).cast("int")).otherwise(0)
    near = near.select("l", "o", F.xxhash64("k", "t").alias("h"), F.substring("t", begin + 1, F.lit(longest)).alias("t")).dropDuplicates(["l", "o", "h"])
    chosen = near.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("o", "h"))).where(F.col("r") <= each).select("l", "t")

    def count(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for i, j, data, offsets in tk.batches(batch, "t"):
                buckets, ends = text_buckets(data, offsets)
                who = np.repeat(np.arange(j - i), np.diff(ends))
                for code in sorted(set(langs[i:j])):
                    n = np.bincount(buckets[(langs[i:j] == code)[who]], minlength=BUCKETS)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([code] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["l", "b", "n"])

    sums = chosen.mapInArrow(count, "l string, b bigint, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    at = {c: n for n, c in enumerate(languages)}
    coded = sums.column("l").combine_chunks().dictionary_encode()
    row = np.array([at[c] for c in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()] if len(sums) else np.zeros(0, dtype=np.int64)
    counts[row, sums.column("b").to_numpy()] = sums.column("n").to_numpy()
    return _model(languages, counts)


#: Three-letter codes (ISO 639-2, both forms) of languages that have a two-letter code.
TWO_LETTERS = dict(
    pair.split(":")
    for pair in (
        "aar:aa abk:ab afr:af aka:ak alb:sq sqi:sq amh:am ara:ar arg:an arm:hy hye:hy asm:as ava:av aym:ay aze:az bak:ba bam:bm baq:eu eus:eu bel:be ben:bn bis:bi bos:bs bre:br bul:bg bur:my mya:my cat:ca "
        "cha:ch che:ce chi:zh zho:zh chv:cv cor:kw cos:co cre:cr cze:cs ces:cs dan:da deu:de ger:de div:dv dut:nl nld:nl dzo:dz eng:en epo:eo est:et ewe:ee fao:fo fas:fa per:fa fij:fj fin:fi fra:fr fre:fr "
        "fry:fy ful:ff geo:ka kat:ka gla:gd gle:ga glg:gl glv:gv gre:el ell:el grn:gn guj:gu hat:ht hau:ha heb:he her:hz hin:hi hrv:hr hun:hu ibo:ig ice:is isl:is ido:io iku:iu ile:ie ina:ia ind:id ipk:ik "
        "ita:it jav:jv jpn:ja kal:kl kan:kn kas:ks kau:kr kaz:kk khm:km kik:ki kin:rw kir:ky kom:kv kon:kg kor:ko kua:kj kur:ku lao:lo lat:la lav:lv lim:li lin:ln lit:lt ltz:lb lub:lu lug:lg mac:mk mkd:mk "
        "mah:mh mal:ml mao:mi mri:mi mar:mr may:ms msa:ms mlg:mg mlt:mt mon:mn nau:na nav:nv nbl:nr nde:nd ndo:ng nep:ne nno:nn nob:nb nor:no nya:ny oci:oc oji:oj ori:or orm:om oss:os pan:pa pli:pi pol:pl "
        "por:pt pus:ps que:qu roh:rm ron:ro rum:ro run:rn rus:ru sag:sg san:sa sin:si slk:sk slo:sk slv:sl sme:se smo:sm sna:sn snd:sd som:so sot:st spa:es srd:sc srp:sr ssw:ss sun:su swa:sw swe:sv tah:ty "
        "tam:ta tat:tt tel:te tgk:tg tgl:tl tha:th tib:bo bod:bo tir:ti ton:to tsn:tn tso:ts tuk:tk tur:tr twi:tw uig:ug ukr:uk urd:ur uzb:uz ven:ve vie:vi vol:vo wel:cy cym:cy wln:wa wol:wo xho:xh yid:yi "
        "yor:yo zha:za zul:zu"
    ).split()
)


def language_code(code: Column) -> Column:
    """The primary part of a language tag in lower case, with two letters where the language has such a code; null for none."""
    first = F.nullif(F.regexp_extract(F.lower(code), r"^\s*([^-_\s]+)", 1), F.lit(""))
    return F.coalesce(F.create_map(*(F.lit(x) for pair in TWO_LETTERS.items() for x in pair))[first], first)


def text_evidence(docs: DataFrame, model: TextModel, *, text: str, output: str = "text_evidence", count: str = "letters", keep_text: bool = False) -> DataFrame:
    """Adds an array with a log-likelihood for each language (zeros for an empty text) and ``count``, the number of words and triples."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if keep_text or c != text]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value.weights
        for batch in arrow:
            for i, j, data, offsets in tk.batches(batch, text):
                buckets, bounds = text_buckets(data, offsets)
                sums = []
                for row in weights:
                    total = np.concatenate([[0.0], np.cumsum(row[buckets])])
                    sums.append(total[bounds[1:]] - total[bounds[:-1]])
                x = np.clip(np.stack(sums, axis=1) * TEMPER, -LIMIT, LIMIT) if sums else np.zeros((j - i, 0))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                kept = [batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in others]
                yield pa.RecordBatch.from_arrays([*kept, flat, pa.array(np.diff(bounds))], names=[*others, output, count])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"{fields}, `{output}` array<double>, `{count}` bigint")


def host_priors(rows: DataFrame, languages: list[str], *, declared: str, host: str, domain: str, suffix: str, strength: float = 20.0) -> DataFrame:
    """(host, prior): an array of log-probabilities for each host, smoothed domain by domain.

    Counts of declared languages by host, domain and suffix; every level takes
    ``strength`` pseudo-counts from the one above it.  Rows are counted before
    they are shuffled, so a host with a third of the rows is one row a task.
    """
    amounts = [F.sum((F.col(declared) == lang).cast("double")).alias(f"n{i}") for i, lang in enumerate(languages)]
    by_host = rows.groupBy(host, domain, suffix).agg(*amounts)
    names = [f"n{i}" for i in range(len(languages))]

    def level(keys: list[str], tag: str) -> DataFrame:
        return by_host.groupBy(*keys).agg(F.array(*(F.coalesce(F.sum(n), F.lit(0.0)) for n in names)).alias(tag))

    def smooth(counts: str, above: str) -> str:
        return f"transform(zip_with({counts}, {above}, (n, p) -> n + {strength} * p), x -> x / ({strength} + aggregate({counts}, 0D, (a, n) -> a + n)))"

    whole = by_host.agg(F.array(*(F.coalesce(F.sum(n), F.lit(0.0)) + 1.0 for n in names)).alias("w"))
    top = whole.select(F.expr("transform(w, n -> n / aggregate(w, 0D, (a, x) -> a + x))").alias("p0"))
    suffixes = level([suffix], "c").crossJoin(F.broadcast(top)).select(F.col(suffix), F.expr(smooth("c", "p0")).alias("p1"))  # one row on the right
    domains = level([domain, suffix], "c").join(suffixes, suffix).select(F.col(domain), F.expr(smooth("c", "p1")).alias("p2"))
    hosts = by_host.select(host, domain, F.array(*(F.coalesce(F.col(n), F.lit(0.0)) for n in names)).alias("c")).join(domains, domain)
    return hosts.select(F.col(host), F.expr(f"transform({smooth('c', 'p2')}, p -> ln(p))").alias("prior"))


def identify(
    docs: DataFrame, *, text: str, host: Column, declared: Column, key: Column, known: Column | None = None,
    trust: float = 3.0, suffixes: dict[str, str] | None = None, sure: float = 0.5, sample: int = 500, keep_text: bool = False,
) -> DataFrame:
    """All columns of ``docs`` but the text (unless ``keep_text``), and ``language``, ``confidence``, ``reliable``.

    ``host`` is the address's host (null or empty: no host, only the
    collection's prior), ``declared`` the declared language (null: no evidence), ``known``
    the language of the training rows (by default the declared one); priors
    count the declared language, or the known one where none is declared.  A text
    without letters has no evidence of its own and is never reliable; other
    texts are if their best language has a probability of ``sure`` at least.
    At most ``sample`` rows of each language train its text model; a language
    without texts has a flat one.  Equal probabilities go to the first language by name.  With no known
    language at all ``language`` is null.  ``trust`` is the log-odds that a
    declaration, and a suffix in ``suffixes`` (suffix to language), adds.
    """
    suffixes = suffixes if suffixes is not None else {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en"}
    named = ["language", "confidence", "reliable"]
    columns = [c for c in docs.columns if c not in named and (keep_text or c != text)]
    p = free_prefix(docs)
    work = docs.drop(*named).withColumns({
        f"{p}host": F.lower(F.coalesce(host, F.lit(""))), f"{p}declared": language_code(declared), f"{p}known": language_code(known if known is not None else declared), f"{p}key": key,
    })
    work = work.withColumn(f"{p}counted", F.coalesce(f"{p}declared", f"{p}known"))
    work = work.withColumn(f"{p}domain", F.regexp_extract(f"{p}host", r"([^.]+\.[^.]+)$", 1)).withColumn(f"{p}suffix", F.regexp_extract(f"{p}host", r"\.([^.]+)$", 1))
    model = fit_sample(work, lang=f"{p}known", also=f"{p}declared", text=text, key=f"{p}key", each=sample)
    if not model.languages:
        return work.select(*columns, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("reliable"))
    priors = host_priors(work, model.languages, declared=f"{p}counted", host=f"{p}host", domain=f"{p}domain", suffix=f"{p}suffix").select(F.col(f"{p}host").alias(f"{p}of"), F.col("prior").alias(f"{p}prior"))
    scored = text_evidence(work.drop(f"{p}known", f"{p}key", f"{p}domain", f"{p}counted"), model, text=text, output=f"{p}text", count=f"{p}letters", keep_text=keep_text)
    joined = scored.join(priors, scored[f"{p}host"] == priors[f"{p}of"], "left")
    names = F.array(*map(F.lit, model.languages))
    of = lambda lang: [s for s, x in suffixes.items() if x == lang]
    bonus = F.array(*(F.when(F.col(f"{p}declared") == lang, trust).otherwise(0.0) + (F.when(F.col(f"{p}suffix").isin(of(lang)), trust).otherwise(0.0) if of(lang) else F.lit(0.0)) for lang in model.languages))
    flat = F.array(*([F.lit(0.0)] * len(model.languages)))
    total = F.zip_with(F.zip_with(f"{p}text", F.coalesce(f"{p}prior", flat), lambda a, b: a + b), bonus, lambda a, b: a + b)
    done = joined.withColumn(f"{p}total", total).withColumn(f"{p}top", F.array_max(f"{p}total"))
    done = done.withColumn("confidence", 1 / F.aggregate(f"{p}total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col(f"{p}top"))))
    done = done.withColumn("language", F.get(names, (F.array_position(f"{p}total", F.col(f"{p}top")) - 1).cast("int")))
    done = done.withColumn("reliable", (F.col(f"{p}letters") > 0) & (F.col("confidence") >= sure))
    return done.select(*columns, *named)


def free_prefix(df: DataFrame) -> str:
    """Underscores that begin no column's name, for columns of our own."""
    p = "_"
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    return p


def markup_language(html: Column) -> Column:
    """The lang attribute of the html element, or of a content-language meta element; null if there is none."""
    attribute = F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)
    meta = F.regexp_extract(html, r"(?i)<meta[^>]*?content-language[^>]*?content\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)
    return F.coalesce(F.nullif(F.lower(attribute), F.lit("")), F.nullif(F.lower(meta), F.lit("")))


def visible_text(html: Column) -> Column:
    """The page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def address_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
