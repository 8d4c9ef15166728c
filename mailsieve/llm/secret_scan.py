"""Operator 8, secret scans with corpus-wide ownership frequency.

Three kinds of candidates are found by pattern in every whole text: assignments
to names such as ``password``, access keys and long hex runs. A fourth kind,
``owned``, takes weaker shapes (long mixed tokens without such a name beside
them), which are secrets only if the corpus says so.

Candidate values travel as hashes. Spark counts for each hash the distinct
repositories that hold it, where copies of one text count once, and its distinct
owners, combined before the shuffle, so a value that a third of all rows hold is a row
per task and distinct text. Both counts decide: a value in ``MANY_REPOS`` or more
repositories of ``SEVERAL_OWNERS`` or more owners is a copied example, and so is one in
``COPIED_REPOS`` or more, whoever owns them; no credential is written down so often.
Any other is specific to its owners and looks live, such as one whose text was copied
to a second owner. Spans of the fourth kind are kept only where they look live; spans
of the three base kinds always stay.

Offsets count code points, ends are exclusive. Defined results: null texts count
as empty; null owners and repositories count as one value; repeated rows are
scanned each; an empty table gives an empty result; other columns are not read.
"""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import small_batches, stage

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
WEAK = re.compile(r"[A-Za-z0-9+/_-]{20,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
MIN_ENTROPY = 3.0
MANY_REPOS, SEVERAL_OWNERS, COPIED_REPOS = 10, 3, 50
#: ASCII letters of hex digits and of weak tokens, for byte tests that spare most texts the patterns.
HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
WEAK_BYTES = bytes(120 if re.fullmatch(r"[A-Za-z0-9+/_-]", chr(b)) else 32 for b in range(256))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and secret value of the three base kinds, in order of start."""
    raw, found = text.encode("utf-8", "surrogatepass"), []
    low = raw.lower()
    if any(name.encode() in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= MIN_ASSIGN:
                found.append(("assign", m.start(), m.end(), m[2]))
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if b"x" * MIN_HEX in raw.translate(HEX_BYTES):
        found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return in_order(found)


def weak_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Long tokens of letters and digits with high entropy, apart from base spans."""
    if b"x" * 20 not in text.encode("utf-8", "surrogatepass").translate(WEAK_BYTES):
        return []
    taken = sorted((start, end) for _, start, end, _ in base)
    found, at = [], 0
    for m in WEAK.finditer(text):
        value = m[0]
        if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
            continue
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if any(start < m.end() and end > m.start() for start, end in taken[at : at + 8]):
            continue
        if entropy(value) >= MIN_ENTROPY:
            found.append(("owned", m.start(), m.end(), value))
    return found


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def in_order(spans: list) -> list:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for id_, text, repo, owner in zip(batch["id"], batch["text"], batch["repo"], batch["owner"]):
            base = base_spans(text or "")
            every = in_order(base + weak_spans(text or "", base))
            counts = Counter(s[0] for s in base)
            rows.append((
                id_, repo, owner, hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest() if every else None,
                counts["assign"], counts["access"], counts["hex"],
                hashlib.sha256(written(base).encode()).hexdigest(),
                [{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()} for k, s, e, v in every],
            ))
        yield pd.DataFrame(rows, columns=["id", "repo", "owner", "copy", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


FOUND = "array<struct<kind:string,start:bigint,end:bigint,hash:string>>"


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """Candidates per row; staged, as both the counts and the result read them."""
    rows = small_batches(docs).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
        F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"),
    )
    # Ids travel as text: pandas has no whole numbers beside nulls.
    schema = f"id string, repo string, owner string, copy string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found {FOUND}"
    return stage(rows.mapInPandas(_scan, schema).withColumn("row", F.expr("uuid()")), "secrets")


def ownership(
    scanned: DataFrame, many_repos: int = MANY_REPOS, several_owners: int = SEVERAL_OWNERS, copied_repos: int = COPIED_REPOS
) -> DataFrame:
    """Per candidate hash: n_repos, n_owners, live."""
    held = scanned.select("repo", "owner", "copy", F.explode("found.hash").alias("hash"))
    held = held.fillna("", ["repo", "owner"])
    counted = held.groupBy("hash").agg(
        F.least(F.count_distinct("repo"), F.count_distinct("copy")).alias("n_repos"), F.count_distinct("owner").alias("n_owners")
    )
    repos, owners = F.col("n_repos"), F.col("n_owners")
    example = ((repos >= many_repos) & (owners >= several_owners)) | (repos >= copied_repos)
    return counted.withColumn("live", ~example)


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
    owner_col: str = "source", many_repos: int = MANY_REPOS, several_owners: int = SEVERAL_OWNERS,
    copied_repos: int = COPIED_REPOS,
) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, how many of its
    secrets look live (n_live) or are copied examples (n_example), and the most
    repositories and owners that hold one of its secrets (n_repos, n_owners)."""
    scanned = scan(docs, id_col, text_col, repo_col, owner_col)
    verdicts = ownership(scanned, many_repos, several_owners, copied_repos)
    spans = scanned.filter(F.size("found") > 0).select("row", F.explode("found").alias("span"))
    judged = spans.join(verdicts, spans["span.hash"] == verdicts["hash"]).select(
        "row", "span.*", "live", "n_repos", "n_owners", F.array_position(F.array(*map(F.lit, KINDS)), F.col("span.kind")).alias("rank")
    )
    kept = judged.filter((F.col("kind") != "owned") | F.col("live"))
    text = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))),
            lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]),
        ),
        ",",
    )
    # The spans of one row only: as many as its text holds.
    per_row = kept.groupBy("row").agg(
        text.alias("spans"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
        F.max("n_repos").alias("n_repos"), F.max("n_owners").alias("n_owners"),
    )
    zero = F.lit(0).cast("bigint")
    return scanned.drop("found", "repo", "owner", "copy").join(per_row, "row", "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"),
        F.coalesce("n_repos", zero).alias("n_repos"), F.coalesce("n_owners", zero).alias("n_owners"),
    )
