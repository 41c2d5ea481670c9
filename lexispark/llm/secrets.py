"""Secret scans: patterns, and character Markov models of random strings and of ordinary identifiers.

Everything on the way of the texts is Spark expressions. The two models are tables of
transition log-probabilities, counted by Spark from labelled samples; a long token is a secret
where the random model explains it better, per character, by more than a margin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, running

#: The base patterns by kind, in the order of kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "markov")
#: Tokens that the models judge: whole runs of these characters, of so many at least.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN, LEAST_TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 20
#: Log-likelihood ratio for each transition, in nats, above which a token counts as random.
MARGIN = 0.5
#: Rows of each class in the built-in labelled sample.
SAMPLE_ROWS = 4000
#: Parts of the sample's ordinary identifiers.
PARTS = (
    "account address amount array average batch before block buffer build cache call category change channel check client close code collection column "
    "command comment commit compare complete config connection content context control convert copy count country create current customer data date default "
    "delete description destination device directory display document download element email enable encode end entry error event example execute expected "
    "export feature field file filter find first folder format function generate global group handle header height history host image import index "
    "information initial input insert install instance internal item key language last layout length level library limit line list load local location "
    "lock log login machine manager map market match maximum memory message method minimum model module monitor name network next node number object offset "
    "open operation option order output owner package page parameter parent parse path pattern payment permission person phone platform player point policy "
    "port position prefix previous price print process product profile project property protocol provider public query queue random range read receive record "
    "reference region register release remote remove render report request resource response result return role root route row rule sample schedule schema "
    "score screen search section security select sequence server service session setting shape share size source stack start state station status step "
    "storage store stream string style subject submit summary support switch system table target task template temporary test text thread threshold time "
    "timeout title total track transaction transfer type unit update upload user validate value variable version video view visible warning weight width window worker write"
).split()


def sample_tokens(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(token, random): labelled tokens made by rule: digests in base 64, in hex and in letters and digits; and names of PARTS joined in usual ways."""
    n, parts = spark.range(rows), F.split(F.lit(" ".join(PARTS)), " ")
    digest = F.unhex(F.sha2(F.concat(F.lit("token "), F.col("id").cast("string")).cast("binary"), 256))
    random = n.select(
        F.when(F.col("id") % 4 == 0, F.lower(F.hex(digest)))
        .when(F.col("id") % 4 == 1, F.upper(F.regexp_replace(F.base64(digest), "[^A-Za-z0-9]", "")))
        .otherwise(F.substring(F.base64(digest), 1, 43))
        .alias("token"),
        F.lit(True).alias("random"),
    )
    part = lambda i: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(PARTS))) + 1).cast("int"))
    ordinary = n.select(
        F.when(F.col("id") % 5 == 0, F.concat_ws("_", part(0), part(1), part(2), part(3)))
        .when(F.col("id") % 5 == 1, F.concat(part(0), *(F.initcap(part(i)) for i in (1, 2, 3))))
        .when(F.col("id") % 5 == 2, F.concat_ws("-", part(0), part(1), part(2), (F.col("id") % 100).cast("string")))
        .when(F.col("id") % 5 == 3, F.concat_ws("/", part(0), part(1), part(2), part(3)))
        .otherwise(F.upper(F.concat_ws("_", part(0), part(1), part(2))))
        .alias("token"),
        F.lit(False).alias("random"),
    )
    return random.union(ordinary)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of transitions, row by row of ALPHABET, from (token, random); add-one smoothing.

    Tokens that are null or shorter than two characters teach nothing; without samples every ratio is 0.
    """
    size = len(ALPHABET)
    pairs = samples.where("token is not null and random is not null").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - 1, F.lit(1))), lambda i: F.col("token").substr(i, F.lit(2)))).alias("pair"))
    counts = pairs.where(F.length("pair") == 2).groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o")).collect()  # at most one row for each pair of characters
    place = {c: i for i, c in enumerate(ALPHABET)}
    table = [[[1.0] * size for _ in range(size)] for _ in range(2)]
    for row in counts:
        a, b = row["pair"]
        if a in place and b in place:
            table[0][place[a]][place[b]] += row["r"]
            table[1][place[a]][place[b]] += row["o"]
    sums = [[sum(x) for x in t] for t in table]
    return [math.log(table[0][i][j] / sums[0][i]) - math.log(table[1][i][j] / sums[1][i]) for i in range(size) for j in range(size)]


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of a pattern's matches in order, in code points.

    Splitting at the pattern and extracting it give what is between matches and the matches; their lengths add up to places.
    """
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    lengths = F.flatten(F.zip_with(gaps, matches, lambda g, m: F.array(F.length(g), F.coalesce(F.length(m), F.lit(0)))))
    starts = F.filter(running(lengths), lambda _, i: i % 2 == 1)
    placed = F.zip_with(starts, matches, lambda s, m: F.struct(s.cast("int").alias("start"), (s + F.length(m)).cast("int").alias("end"), m.alias("match")))
    return F.when(text.rlike(pattern), F.filter(placed, lambda x: x["match"].isNotNull())).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>>, sorted: leftmost matches of each base pattern that don't overlap, without those that are too short."""
    # All assignments take part in finding places; those with a short value go afterwards.
    assign = F.filter(_located(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= LEAST["assign"])
    # A run that is too short holds no match that is long enough, so these are looked for with their least lengths.
    access = _located(text, f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}")
    hexes = _located(text, f"[0-9a-f]{{{LEAST['hex']},}}")
    return F.sort_array(F.concat(_tagged(assign, "assign"), _tagged(access, "access"), _tagged(hexes, "hex")))


def token_ratio(token: Column, ratios: Column) -> Column:
    """The mean log-likelihood ratio of a token's transitions."""
    size = len(ALPHABET)
    at = F.transform(F.split(token, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1)
    n = F.greatest(F.size(at) - 1, F.lit(0))
    steps = F.zip_with(F.slice(at, F.lit(1), n), F.slice(at, F.lit(2), n), lambda a, b: F.element_at(ratios, a * size + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(n, F.lit(1))


def model_spans(text: Column, ratios: list[float]) -> Column:
    """array<struct<start, kind, end>> of tokens that the random model explains better; a token inside a longer one is no token."""
    known = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded into one literal
    return _tagged(F.filter(_located(text, TOKEN), lambda s: token_ratio(s["match"], known) > MARGIN), "markov")


def uncovered(spans: Column, base: Column) -> Column:
    """Those of spans that no span of base covers; both are (start, kind, end), and kinds of base come first."""
    events = lambda both: F.zip_with(both, running(F.transform(both, lambda s: F.when(s["kind"] < KINDS.index("markov"), s["end"]).otherwise(F.lit(0))), largest=True), lambda s, far: F.struct(s.alias("span"), far.alias("far")))
    own = lambda e: (e["span"]["kind"] == KINDS.index("markov")) & (e["span"]["end"] > e["far"])
    # In order of starts, a span is covered if a base span before it ends behind its end.
    return F.transform(F.array(F.sort_array(F.concat(base, spans))), lambda both: F.transform(F.filter(events(both), own), lambda e: e["span"]))[0]


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text") -> DataFrame:
    """docs with base_spans and spans, arrays of (start, kind, end) sorted by start, then kind; a name that docs has already gets underscores until it is new.

    kind is a place in KINDS. Spans are in code points, end exclusive. Null text counts as empty and has none.
    A model's span that a base span covers isn't reported again. Rows may repeat; an empty table stays empty. Texts may be of any
    length and have any number of matches: the work grows with the length, but for one sort of the matches.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base_name, name = fresh(docs.columns, "base_spans"), fresh(docs.columns, "spans")
    base, found = F.col(f"`{base_name}`"), model_spans(text, ratios)
    based = docs.withColumn(base_name, base_spans(text))
    return based.withColumn(name, F.transform(F.array(found), lambda own: F.when(F.size(own) > 0, F.sort_array(F.concat(base, uncovered(own, base)))).otherwise(base))[0])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
