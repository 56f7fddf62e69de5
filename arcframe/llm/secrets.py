"""Secret scans with corpus-wide ownership, in DataFrame operations alone.

Patterns give candidate spans. The values of the candidates are hashed and counted over the corpus: by
distinct repositories and distinct owners. A value that many owners share is an example that was copied
around; one that few owners have is live-looking. Spans of the vendor patterns, which the base patterns
don't cover, are reported only while their value is live-looking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: The base patterns, in the order in which their kinds are listed.
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = {
    "assign": ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+",
    # runs are as long as they can be, so that too short ones may as well not match
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
ASSIGN_LEAST = 6
#: A private key from its header to its END line; where that is missing, as far as lines of base64 go (breaks may be
#: escaped). A header without either is matched alone. Quantifiers are possessive in the two forms that the oracle's
#: dialect can do without.
PEM_HEAD, PEM_END = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", r"-----END [A-Z ]{0,30}PRIVATE KEY-----"
PEM_WHOLE = r"[^-]*+(?:-{1,4}[^-]{1,}+)*+" + PEM_END
PEM_BREAK = r"(?:[\x20\t\r\n]|\\{1,2}[nr])"
PEM_CUT = "(?:" + PEM_BREAK + "*+[A-Za-z0-9+/=]{16,}+){1,}+(?:" + PEM_BREAK + "{1,}+[A-Za-z0-9+/=]{1,}+)?"
#: Public shapes of vendors' tokens: code hosts, chat, model and payment services, signed web tokens, private keys.
VENDOR = {
    "vendor": r"gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|(?:sk|rk|pk)[-_](?:live|test|proj)[-_][A-Za-z0-9_-]{16,}+|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}+",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]*+",
    "pem": PEM_HEAD + "(?:" + PEM_WHOLE + "|" + PEM_CUT + ")?",
}
KINDS = BASE | VENDOR
#: A value that more owners than this have is a copied example, and so is one in more repositories than this: an
#: owner may keep a credential in several repositories, but not in very many.
LIVE_OWNERS, LIVE_REPOS = 2, 8
#: A value with more uses than this is hot: its rows find their verdict without meeting in one task. Verdicts of
#: up to so many hot values, some MB, are broadcast.
HOT_USES, BROADCAST_ROWS = 1 << 17, 100_000
#: Cheap test of where a pattern can start, put in front of it.
STARTS = {"assign": "(?=[pPsStTaA])"}


def literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def matches(text: str, kind: str) -> Column:
    """All matches of a kind in the column named text, left to right, not overlapping."""
    return F.expr(f"regexp_extract_all({text}, {literal(STARTS.get(kind, '') + KINDS[kind])}, 0)")


def spans(text: str, kind: str, found: str) -> Column:
    """array<struct<kind, start, end, value>> of the matches in the column named found, in code points.

    The text between the matches comes from splitting it at the same pattern, so that starts are sums
    of lengths. The sums go over blocks of about the square root of the number of matches. Matches whose
    value is too short are dropped after the sums.
    """
    lengths = (
        f"transform(slice(split({text}, {literal(STARTS.get(kind, '') + KINDS[kind])}, -1), 1, size({found})), (gap, i) -> named_struct("
        f"'gap', char_length(gap), 'all', char_length(gap) + char_length({found}[i])))"
    )
    step = f"cast(ceil(sqrt(size({found}))) as int)"
    # blocks[b].before: length of everything in front of block b
    blocks = (
        f"transform(sequence(0, (size(p) - 1) div {step}), b -> aggregate(slice(p, int(b * {step} + 1), {step}), 0L, (s, x) -> s + x.all))"
    )
    before = f"transform(q, (x, b) -> aggregate(slice(q, 1, b), 0L, (s, y) -> s + y))"
    value = f"regexp_replace(x, {literal('^' + ASSIGN_HEAD)}, '')" if kind == "assign" else "x"
    least = ASSIGN_LEAST if kind == "assign" else 1
    inner = (
        f"transform({found}, (x, i) -> named_struct('kind', '{kind}', 'start', "
        f"o[i div {step}] + aggregate(slice(p, int((i div {step}) * {step} + 1), int(i % {step})), 0L, (s, y) -> s + y.all) + p[i].gap, 'value', {value}))"
    )
    # transform over one element binds a name once
    bind = f"transform(array({lengths}), p -> transform(array({blocks}), q -> transform(array({before}), o -> {inner})[0])[0])[0]"
    whole = f"transform({bind}, (x, i) -> named_struct('kind', x.kind, 'start', x.start, 'end', x.start + char_length({found}[i]), 'value', x.value))"
    empty = "cast(array() as array<struct<kind:string, start:bigint, `end`:bigint, value:string>>)"
    return F.expr(f"case when size({found}) > 0 then filter({whole}, x -> char_length(x.value) >= {least}) else {empty} end")


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """id, repo, owner, row (a number for each row) and spans (kind, start, end, hash), without the texts."""
    # a null owner or repository is one of its own
    names = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")).alias(n) for c, n in ((repo_col, "repo"), (owner_col, "owner"))]
    rows = docs.select(F.col(id_col).alias("id"), *names, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *[matches("text", k).alias(f"m_{k}") for k in KINDS])
    rows = rows.select("id", "repo", "owner", F.concat(*[spans("text", k, f"m_{k}") for k in KINDS]).alias("spans"))
    hashed = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["value"], F.lit(0)).alias("hash"), F.char_length(x["value"]).alias("length")))
    # numbers are fixed once the rows are written
    return checkpointed(rows.select("id", "repo", "owner", F.monotonically_increasing_id().alias("row"), hashed.alias("spans")))


def ownership(found: DataFrame) -> DataFrame:
    """hash, uses, repos and owners of every candidate value. Counted by value, repository and owner first,
    so that a value that is everywhere meets as one row for each of its repositories."""
    values = found.select("repo", "owner", F.explode("spans.hash").alias("hash"))
    each = values.groupBy("hash", "owner", "repo").agg(F.count("*").alias("uses"))
    by_owner = each.groupBy("hash", "owner").agg(F.sum("uses").alias("uses"), F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("uses").alias("uses"), F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def _with_verdicts(spans: DataFrame, verdicts: DataFrame) -> DataFrame:
    """spans with live of their value. Hot values are told by a broadcast, the others by a join."""
    at = F.col("span.hash") == F.col("h")
    hot = verdicts.where(F.col("uses") > HOT_USES)
    if not 0 < hot.count() <= BROADCAST_ROWS:  # with more hot values than that, none is a large share of all
        return spans.join(verdicts, at)
    few, many = F.broadcast(hot), verdicts.where(F.col("uses") <= HOT_USES)
    return spans.join(few, at).unionByName(spans.join(few, at, "left_anti").join(many, at))


def _ordered(items: Column) -> Column:
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(items, lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["live"].alias("live")))
    return F.array_sort(keyed)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", live_owners: int = LIVE_OWNERS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """Spans of secrets in every whole text, with the ownership of their values over the corpus.

    Returns, one row for each input row: id_col; n_assign, n_access, n_hex (spans of the base kinds);
    n_live and n_example (spans whose value at most live_owners owners have, in at most live_repos
    repositories, and the others); found,
    array<struct<start, rank, end, kind, live>> in order of start, then kind. Base spans are all in found,
    spans of the vendor kinds where they are live. Offsets are code points, ends exclusive. A null text
    counts as empty; null and repeated ids pass through; a null owner or repository counts as one of its
    own; an empty table gives no rows; other columns are left out.
    """
    rows = candidates(docs, id_col, text_col, repo_col, owner_col)
    with_any = rows.where(F.size("spans") > 0).select("row", F.explode("spans").alias("span"))
    live = (F.col("owners") <= live_owners) & (F.col("repos") <= live_repos)
    verdicts = checkpointed(ownership(rows).select(F.col("hash").alias("h"), "uses", live.alias("live")))
    judged = _with_verdicts(with_any, verdicts)
    judged = judged.select("row", F.struct("span.kind", "span.start", "span.end", "live").alias("span")).where(F.col("span.live") | F.col("span.kind").isin(*BASE))
    per_row = judged.groupBy("row").agg(F.collect_list("span").alias("items"))
    none = F.expr("cast(array() as array<struct<kind:string, start:bigint, `end`:bigint, live:boolean>>)")
    joined = rows.drop("spans", "repo", "owner").join(per_row, "row", "left").withColumn("items", F.coalesce("items", none))
    counted = lambda test: F.size(F.filter("items", test)).cast("long")
    of_kind = lambda kind: lambda x: x["kind"] == kind  # noqa: E731  a second parameter would be the index
    return joined.select(
        F.col("id").alias(id_col),
        *[counted(of_kind(k)).alias(f"n_{k}") for k in BASE],
        counted(lambda x: x["live"]).alias("n_live"),
        counted(lambda x: ~x["live"]).alias("n_example"),
        _ordered(F.col("items")).alias("found"),
    )


def digest(found: DataFrame) -> DataFrame:
    """scan_secrets with its spans as text: base_sha256 of the base kinds' and spans of all, kind:start:end."""
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    text = lambda items: F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(*[c for c in found.columns if c != "found"], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def redact(text: Column, items: Column, mask: str = "[secret]") -> Column:
    """text with the stretches that the live spans of items cover replaced by mask. Overlapping spans are one stretch."""
    live = F.filter(items, lambda x: x["live"])
    ends = lambda n: F.coalesce(F.array_max(F.transform(F.slice(live, 1, n), lambda x: x["end"])), F.lit(0).cast("long"))

    def piece(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0).cast("long")).otherwise(ends(F.greatest(i, F.lit(1))))
        gap = F.substring(text, (before + 1).cast("int"), F.greatest(x["start"] - before, F.lit(0)).cast("int"))
        return F.concat(gap, F.when((i == 0) | (x["start"] >= before), F.lit(mask)).otherwise(F.lit("")))

    tail = F.substring(text, (ends(F.size(live)) + 1).cast("int"), F.lit(2**31 - 1))
    return F.when(F.size(live) > 0, F.concat(F.array_join(F.transform(live, piece), ""), tail)).otherwise(text)


ANY = "(?:" + "|".join(STARTS.get(k, "") + p for k, p in KINDS.items()) + ")"


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", live_owners: int = LIVE_OWNERS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """docs with the live-looking secrets of each text masked; copied examples stay. Columns are kept.

    A null text stays null, an empty table empty. Rows without a candidate pass straight through. The others
    are numbered and written before their spans are joined to them, so that repeated rows and ids can't be
    confused and only their texts are shuffled.
    """
    text = F.col(f"`{text_col}`").cast("string")
    suspicious = F.coalesce(text.rlike(ANY), F.lit(False))
    numbered = checkpointed(docs.where(suspicious).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("number")))
    rows = numbered.select("number", F.col(f"doc.`{text_col}`").alias("text"), F.col(f"doc.`{repo_col}`").alias("repo"), F.col(f"doc.`{owner_col}`").alias("owner"))
    found = scan_secrets(rows, "number", "text", "repo", "owner", live_owners, live_repos)
    masked = redact(F.col(f"doc.`{text_col}`").cast("string"), F.col("found"))
    joined = numbered.join(found.select("number", "found"), "number").withColumn("masked", masked)
    return docs.where(~suspicious).union(joined.select(*[F.col("masked").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]))
