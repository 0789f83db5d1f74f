"""Secret scans with corpus-wide ownership frequency, with DataFrame operations only.

Patterns give candidate spans.  Each candidate value is hashed and counted over the
distinct repositories and owners that hold it: a value that many owners share, or
that one owner has in many repositories, is an example that was copied around; a
value of few of both that looks random is live.  To look random a value mixes letters
and digits, its characters have MIN_ENTROPY bits or more each, and it holds no word
that marks placeholders.

Live values are then also found where no pattern with a keyword points to them:
every bare token of the corpus that equals one is added as a span.  A bare token is a
run of eight characters or more of a value's alphabet; it also equals a live value if
it does so after leading `key=` parts, trailing '.' and '=', or both are left out (of
the live value too, for those at its end).

Positions are running sums over the pieces between matches, by row and in order, so
time and memory grow with the length of a text and the number of its matches alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import sized, written

#: The kinds in order, their patterns, the group that is the value, and the least length of that group.
KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
KINDS = {
    "assign": (KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}
#: What a text must hold for a kind to match at all; it spares other texts the search for positions.
NEEDS = {"assign": KEYWORD, "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
#: For the search of positions: the same spans as KINDS after short matches are dropped, as a run of
#: the class is matched whole.
SEARCH = {"assign": KINDS["assign"][0], "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
#: Bare tokens: whole runs of LEAST_TOKEN characters or more that mix letters and digits.
LEAST_TOKEN = 8
RUN = "[A-Za-z0-9+/_.=-]{8,}"
TOKEN = "(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])" + RUN
BARE_NEEDS = "[A-Za-z][+/_.=-]*[0-9]|[0-9][+/_.=-]*[A-Za-z]"
#: A value of more owners or more repositories than this is an example; live values look random.
MAX_OWNERS, MAX_REPOS, MIN_ENTROPY = 2, 3, 2.5
#: Fixed value: words that mark placeholders, in lower case.
PLACEHOLDER = "example|changeme|placeholder|your[_-]|dummy|sample|redacted"
OWNED = "owned"


def pieces(text: Column, pattern: str, group: int, needs: str) -> Column:
    """Array of (gap, len, v) of all matches: code points before the match since the last one, its length, its group; null without any."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(text.rlike(needs), F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("len"), value.alias("v")))


def positions(rows: DataFrame, column: str) -> DataFrame:
    """(id, s, e, v) of the matches in a column of `pieces`."""
    out = rows.where(F.col(column).isNotNull()).select("id", F.posexplode(column).alias("at", "p")).where("p.len is not null")
    end = F.expr("sum(p.gap + p.len) OVER (PARTITION BY id ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").cast("int")
    return out.withColumn("e", end).select("id", (F.col("e") - F.col("p.len")).alias("s"), "e", "p.v")


def mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def entropy(value: Column) -> Column:
    """Bits a character, from the value's own frequencies; one pass for each different character."""
    n = F.length(value)
    share = F.transform(F.array_distinct(F.split(value, "")), lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def random_looking(value: Column) -> Column:
    return mixed(value) & ~F.lower(value).rlike(PLACEHOLDER) & (F.round(entropy(value), 9) >= MIN_ENTROPY)


def bare_end(value: Column) -> Column:
    """The value without the full stops and equals signs at its end."""
    return F.regexp_replace(value, "[.=]+$", "")


def forms(token: DataFrame) -> DataFrame:
    """(id, run, s, e, hash) of what each token (id, s, e, v) may stand for: itself, without `key=` parts, without its end, or both.

    Parts end at the token's equals signs; none starts at an equals sign but the token itself.
    """
    part = F.posexplode(F.split("v", "=")).alias("k", "w")
    before = F.expr("coalesce(sum(length(w) + 1) OVER (PARTITION BY id, s ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").cast("int")
    cut = token.where("v like '%=%'").select("id", "s", "e", "v", part).withColumn("at", before).where("k = 0 or w <> ''").drop("k", "w")
    cut = cut.union(token.where("v not like '%=%'").select("id", "s", "e", "v", F.lit(0).alias("at")))
    tail = F.substring(F.col("v"), F.col("at") + 1, F.length("v"))
    both = cut.withColumn("f", F.explode(F.array_distinct(F.array(tail, bare_end(tail)))))
    both = both.where((F.length("f") >= LEAST_TOKEN) & mixed(F.col("f")))
    start = F.col("s") + F.col("at")
    return both.select("id", F.col("s").alias("run"), start.alias("s"), (start + F.length("f")).alias("e"), F.sha2("f", 256).alias("hash"))


def outside(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """Tokens (id, run, s, e) that overlap no base span (id, s, e): none that starts before a token's end reaches past its start."""
    mark = base.select("id", F.col("s").alias("at"), F.lit(1).alias("base"), F.col("e").alias("reach"), F.lit(None).cast("struct<run:int,s:int,e:int>").alias("t"))
    ask = tokens.select("id", F.col("e").alias("at"), F.lit(0).alias("base"), F.lit(None).cast("int").alias("reach"), F.struct("run", "s", "e").alias("t"))
    reach = F.expr("max(reach) OVER (PARTITION BY id ORDER BY at, base ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return mark.union(ask).withColumn("reach", reach).where("t is not null and (reach is null or reach <= t.s)").select("id", "t.*")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_live, n_copied for each row.

    Base spans are those of KINDS.  n_live counts base spans whose value is live: at
    most `max_owners` distinct owners and `max_repos` distinct repositories hold it, and
    it looks random; n_copied counts the rest.  Added spans (kind `owned`) are bare tokens equal to a
    live value, as the module says, and outside all base spans; one for each token.  A null text is empty; null owners and
    repositories count as one each.  Repeated rows are rows of their own, of one
    owner and repository.  Texts may be of any length and hold any number of matches.  Other columns are not used.
    """
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), owner.alias("owner"), repo.alias("repo"))
    made = [pieces(F.col("text"), SEARCH[k], KINDS[k][1], NEEDS[k]).alias(k) for k in KINDS]
    rows = written(base.select("doc_id", "owner", "repo", *made, pieces(F.col("text"), TOKEN, 0, BARE_NEEDS).alias("bare")).withColumn("id", F.monotonically_increasing_id()))

    found = reduce(DataFrame.union, (positions(rows, kind).where(F.length("v") >= KINDS[kind][2]).select("id", "s", F.lit(k).alias("k"), "e", F.lit(kind).alias("kind"), F.sha2("v", 256).alias("hash"), "v") for k, kind in enumerate(KINDS)))
    found = written(found)
    # Distinct holders first, so that a value copied everywhere is a few rows by now.
    holders = found.select("id", "v").join(rows.select("id", "owner", "repo"), "id").select("owner", "repo", "v").distinct()
    counted = holders.groupBy("v").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))
    short = bare_end(F.col("v"))
    short = F.when((short != F.col("v")) & (F.length(short) >= LEAST_TOKEN) & mixed(short), F.sha2(short, 256))
    values = written(counted.select(F.sha2("v", 256).alias("hash"), short.alias("short"), ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos) & random_looking(F.col("v"))).alias("live")))
    # A live value without its end is looked for as well, unless it is a known value itself.
    ended = values.where("live and short is not null").select(F.col("short").alias("hash")).distinct().join(values.select("hash"), "hash", "left_anti")
    wanted = sized(written(values.where("live").select("hash").union(ended)))
    spans = found.select("id", "s", "k", "e", "kind", "hash").join(values.select("hash", "live"), "hash").select("id", "s", "k", "e", "kind", "live")
    # Each token once with each of its forms that is a live value; the longest that overlaps no base span counts.
    more = outside(forms(positions(rows, "bare")).join(wanted, "hash", "left_semi"), found)
    more = more.groupBy("id", "run").agg(F.min_by(F.struct("s", "e"), F.struct("s", -F.col("e"))).alias("b"))
    more = more.select("id", "b.s", F.lit(len(KINDS)).alias("k"), "b.e", F.lit(OWNED).alias("kind"), F.lit(True).alias("live"))
    span, is_base = F.struct("s", "k", "e", "kind"), F.col("kind") != OWNED
    by_row = spans.union(more).groupBy("id").agg(
        F.sort_array(F.collect_list(span)).alias("all"), *(F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in KINDS), F.count_if(~is_base).alias("n_added"),
        F.count_if(is_base & F.col("live")).alias("n_live"), F.count_if(is_base & ~F.col("live")).alias("n_copied"),
    )
    out = rows.select("id", "doc_id").join(by_row, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    text = lambda spans: F.coalesce(listed(spans), F.lit(""))
    return out.select("doc_id", *(zero(f"n_{k}") for k in KINDS), F.sha2(text(F.filter("all", lambda x: x["kind"] != OWNED)), 256).alias("base_sha256"), text(F.col("all")).alias("spans"), zero("n_added"), zero("n_live"), zero("n_copied"))
