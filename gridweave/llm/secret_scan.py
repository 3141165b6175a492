"""Secret scans: base patterns and character Markov models. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole

ASSIGN = r"""(?=[AaPpSsTt])(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Shorter matches of these two fail, and no shorter match hides a longer one, so the bound is in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"(?<![0-9a-f])[0-9a-f]{32,}+"
MIN_ASSIGN = 8
KINDS = ("assign", "access", "hex", "markov")

#: Candidates of the Markov models: runs of token characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Parts of a run between its separators, which are scored where the run as a whole is not taken.
PART = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]{20,}+"
#: Printable ASCII, 95 characters, and one state for the start of a string.
STATES, SMOOTHING, LEAN = 96, 0.5, 0.7

#: Labelled sample of ordinary names, joined in pairs and triples by usual separators when a model is trained.
ORDINARY = """
account action active address agent amount array async attribute author backend balance batch binary block body
boolean branch browser buffer build button cache callback campaign category center channel character check child
class client cluster code collection color column command comment commit common company component config connection
consumer container content context control cookie count country create current customer cursor database date default
delete department description design device dictionary directory display document domain driver element email enable
encoding engine entity entry environment error event example exception execute export expression extension factory
feature field file filter first folder format frame function gateway generator global graph group handler header
height history horizontal hostname identifier image implementation import index information initial input instance
integer interface internal international iterator journal keyboard label language layout length library limit
listener local location logger management manager mapping margin matrix maximum measure member memory message
metadata method middle minimum model module monitor network notification number object operation option order
organization output owner package padding parameter parent parser partition password path payment performance
""".split()


def labelled_samples(spark: SparkSession, n: int = 4000, first: int = 0, words: list[str] = ORDINARY) -> DataFrame:
    """(text, label): n random strings in base 64, base 62, upper case and hex (label 1), and n names and paths made of words (label 0).

    Samples of numbers from first on: those of ranges that do not meet are different strings.
    """
    ids = spark.range(first, first + n)
    h = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(h))
    random = F.element_at(F.array(b64, F.regexp_replace(b64, "[+/=]", ""), F.substring(h, 1, 40), F.upper(F.regexp_replace(b64, "[+/=a-z]", "7")), F.translate(b64, "+/", "-_")), (F.col("id") % 5 + 1).cast("int"))
    listed = F.array(*map(F.lit, words))
    pick = lambda i: F.element_at(listed, (F.conv(F.substring(h, 1 + 8 * i, 7), 16, 10).cast("long") % len(words) + 1).cast("int"))
    parts = F.array(pick(0), pick(1), pick(2), pick(3))
    name = F.element_at(F.array(F.array_join(parts, "_"), F.array_join(F.transform(parts, F.initcap), ""), F.array_join(parts, "-"), F.array_join(parts, "/"), F.upper(F.array_join(parts, "_")), F.array_join(F.slice(parts, 1, 3), ""), F.concat(F.array_join(parts, "_"), F.col("id") % 100), F.array_join(parts, "")), (F.col("id") % 8 + 1).cast("int"))
    return ids.select(random.alias("text"), F.lit(1).alias("label")).union(ids.select(name.alias("text"), F.lit(0).alias("label")))


def _states(text: Column) -> Column:
    """State numbers of a string's characters: 1 to 95 for printable ASCII, else 0."""
    code = lambda c: F.when(F.ascii(c).between(32, 126), F.ascii(c) - 31).otherwise(0)
    return F.transform(F.split(text, "", -1), code)


def train(samples: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratio of each transition, random over ordinary: STATES * STATES numbers, row by row.

    First-order models with additive smoothing, from (text, label) rows; the
    table's size is fixed, so only it comes to the driver.
    """
    s = samples.where(F.col("text").isNotNull() & F.col("label").isNotNull()).select((F.col("label") > 0).alias("y"), F.filter(_states(F.col("text")), lambda c: c > 0).alias("s")).where("size(s) > 0")
    steps = s.select("y", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("s", 1, F.size("s") - 1)).alias("a"), F.col("s").alias("b"))).alias("t"))
    counts = {(r.y, r.a, r.b): r.n for r in steps.groupBy("y", "t.a", "t.b").agg(F.count(F.lit(1)).alias("n")).collect()}
    import math

    def logs(y: bool) -> list[float]:
        rows = [[counts.get((y, a, b), 0) + smoothing for b in range(STATES)] for a in range(STATES)]
        return [math.log(x / sum(r)) for r in rows for x in r]

    return [a - b for a, b in zip(logs(True), logs(False), strict=True)]


def log_ratio(text: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per character; linear in the text's length."""
    weights = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # folded to one literal
    zero = F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("s"))
    step = lambda st, c: F.struct(c.alias("p"), (st.s + F.element_at(weights, st.p * STATES + c + 1)).alias("s"))
    return F.aggregate(_states(text), zero, step, lambda st: st.s) / F.greatest(F.char_length(text), F.lit(1))


def fit(samples: DataFrame, smoothing: float = SMOOTHING) -> tuple[list[float], float]:
    """A table from train() on one half of the samples, and a threshold from the other half.

    The threshold lies between what all but one in 200 ordinary strings stay
    below and what all but one in 50 random ones exceed, LEAN of the way up: other
    languages' words are further from the ordinary sample than from it are keys.
    """
    half = F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2))
    table = train(samples.where(half == 0), smoothing)
    scored = samples.where(half == 1).select("label", log_ratio(F.col("text"), table).alias("r"))
    of = lambda label, q: F.percentile(F.when(F.col("label") == label, F.col("r")), F.lit(q))
    low, high = scored.agg(of(0, 0.995), of(1, 0.02)).first()
    return table, low + LEAN * (high - low)


def _located(text: Column, pattern: str, group: int, needs: Column | None = None) -> Column:
    """(start, end, hit, match) of each leftmost match, in code points: what lies between matches gives the places.

    start, end and hit are those of the group, match is where the whole match starts; a group ends where its match does.
    needs: something cheap without which the pattern cannot match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), own.alias("own"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,match:bigint>>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(st, x):
        end = st.at + x.gap + F.coalesce(F.char_length(x.hit), F.lit(0))
        span = F.struct((end - F.char_length(x.own)).cast("long").alias("start"), end.cast("long").alias("end"), x.own.alias("hit"), (st.at + x.gap).cast("long").alias("match"))
        return F.struct(end.cast("long").alias("at"), F.when(x.hit.isNull(), st.out).otherwise(F.concat(st.out, F.array(span))).alias("out"))

    return F.when(text.rlike(pattern) if needs is None else needs & text.rlike(pattern), F.aggregate(zipped, zero, step, lambda st: st.out)).otherwise(none)


def scan(docs: DataFrame, model: tuple[list[float], float] | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end, match) of every whole text, by start, then kind.

    kind is a place in KINDS. Base spans come from the patterns; that of an assign
    match is its value (group 2), without the key word, and match is where the
    whole match starts, with the key word (of other kinds: start). The Markov models add
    candidates with a letter and a digit whose mean log-likelihood ratio exceeds
    threshold, unless they touch a base span. Of runs that are not added, the
    parts between / = - and _ are scored in the same way on their own. A key
    without any digit is not added: one in 30 random base-64 strings of 20
    characters, one in 800 of 40. model: transition ratios and threshold, by
    default those that fit() gives for labelled_samples().

    One pass, no shuffle. Null text counts as empty and has no span; other
    columns are ignored; each row gives a row.
    """
    table, threshold = fit(labelled_samples(docs.sparkSession)) if model is None else model
    text = F.col("text")
    d = docs.select(F.col("doc_id"), whole("text").alias("text"))
    d = d.select("doc_id", _located(text, ASSIGN, 1, F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))).alias("assign"), _located(text, ACCESS, 0, F.contains(text, F.lit("AKIA"))).alias("access"), _located(text, HEX, 0).alias("hex"), _located(text, CANDIDATE, 0).alias("markov"), _located(text, PART, 0).alias("parts"))

    def tagged(kind: int, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x.start.alias("start"), F.lit(kind).alias("kind"), x.end.alias("end"), x.match.alias("match")))

    base = F.concat(tagged(0, F.filter("assign", lambda x: x.end - x.start >= MIN_ASSIGN)), tagged(1, F.col("access")), tagged(2, F.col("hex")))
    d = d.select("doc_id", "markov", "parts", F.array_sort(base).alias("base"))
    looks = lambda x: x.hit.rlike("[0-9]") & x.hit.rlike("[A-Za-z]") & (log_ratio(x.hit, table) > threshold)
    clear = lambda x, of: ~F.exists(of, lambda b: (b.start < x.end) & (x.start < b.end))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,match:bigint>>")
    add = lambda of, rest: F.when(F.size(of) > 0, tagged(3, F.filter(of, lambda x: rest(x) & looks(x)))).otherwise(none)
    d = d.select("doc_id", "base", "parts", add("markov", lambda x: clear(x, "base")).alias("found"))
    extra = F.concat("found", add("parts", lambda x: clear(x, "base") & clear(x, "found")))
    return d.select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def _joined(spans: str) -> Column:
    """kind:start:end of each whole match, an assign's key word included, by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    matches = F.array_sort(F.transform(spans, lambda x: F.struct(x.match.alias("start"), x.kind.alias("kind"), x.end.alias("end"))))
    return F.array_join(F.transform(matches, lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.start, x.end)), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir)).select("doc_id", "base", "spans")
    n = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
