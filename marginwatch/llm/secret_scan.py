"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates of every text are located by patterns; their hashes are counted over the whole corpus by
distinct owners and repositories. A value that many owners hold is a copied example, one that a
single owner holds in few repositories looks live. The base patterns' spans are always reported; a
random-looking string without a keyword is reported only where its ownership makes it look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginwatch.llm.common import staged

# The base patterns. Lower bounds are put where they cannot change what matches.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Longer runs of token characters; those of one class only are words or numbers.
LOOSE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "live")


# Characters of a text that are cut out of it at a time.
CHUNK = 4096


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(n: Column) -> Column:
    """0 to n - 1; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _width(n: Column) -> Column:
    """Entries of a block, about the root of their number: work on n entries grows with n * sqrt(n)."""
    return F.greatest(F.lit(16), F.sqrt(n).cast("int"))


def _block(width: Column, i: Column) -> Column:
    return F.floor(i / width).cast("int")


def _before(values: Column, merge) -> Column:
    """For each entry what ``merge`` makes of 0 and all entries before it.

    Blocks are merged first and then the entries of the own block, since a list that grows by one
    entry at a time is copied each time.
    """

    def merged(entries: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(entries, first + 1, n), F.lit(0), merge)

    def over(v: Column) -> Column:
        x, w = v["x"], v["w"]
        blocks = F.transform(_places(F.ceil(F.size(x) / w).cast("int")), lambda b: merged(x, b * w, w))
        heads = _let(blocks, lambda h: F.transform(_places(F.size(h)), lambda b: merged(h, F.lit(0), b)))
        return _let(
            heads,
            lambda h: F.transform(
                _places(F.size(x)),
                lambda i: merge(F.get(h, _block(w, i)), merged(x, _block(w, i) * w, i % w)),
            ),
        )

    return _let(values, lambda x: _let(F.struct(x.alias("x"), _width(F.size(x)).alias("w")), over))


def _located(text: str, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, value), in code points from 0.

    The text is split at the matches; a match starts after all pieces and matches before it.
    """
    def paired(matches: Column) -> Column:
        pieces = F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(matches))
        return F.zip_with(
            pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m"), F.length(m).alias("n"))
        )

    def placed(found: Column) -> Column:
        offsets = _before(F.transform(found, lambda f: f["gap"] + f["n"]), lambda a, b: a + b)
        return F.zip_with(
            found,
            offsets,
            lambda f, at: F.struct(
                (at + f["gap"]).alias("start"),
                F.lit(kind).alias("kind"),
                (at + f["gap"] + f["n"]).alias("end"),
                f["m"].alias("value"),
            ),
        )

    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return _let(
        F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)),
        # most texts hold none and are not split
        lambda matches: F.when(F.size(matches) > 0, _let(paired(matches), placed)).otherwise(none),
    )


def _clear_of(spans: Column, others: Column) -> Column:
    """``spans`` with ``clear``: whether none of ``others``, sorted and apart from each other, overlaps."""

    def blocked(o: Column) -> Column:
        n = F.size(o)

        def block(b: Column) -> Column:
            part = F.slice(o, b * _width(n) + 1, _width(n))
            ends = (F.element_at(part, 1)["start"].alias("start"), F.element_at(part, -1)["end"].alias("end"))
            return F.struct(*ends, part.alias("part"))

        return F.transform(_places(F.ceil(n / _width(n)).cast("int")), block)

    def overlap(s: Column, o: Column) -> Column:
        return (o["start"] < s["end"]) & (s["start"] < o["end"])

    return _let(
        _let(others, blocked),
        lambda blocks: F.transform(
            spans,
            lambda s: s.withField(
                "clear",
                ~F.exists(blocks, lambda b: overlap(s, b) & F.exists(b["part"], lambda o: overlap(s, o))),
            ),
        ),
    )


def _value(match: Column, kind: Column) -> Column:
    return F.when(kind == 0, F.regexp_extract(match, ASSIGN, 2)).otherwise(match)


def _spans(found: str) -> Column:
    """'kind:start:end' of the spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(
        F.array_sort(F.col(found)),
        lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
        ),
    )
    return F.array_join(parts, ",")


def candidates(docs: DataFrame, *, owner: str = "source", repository: str = "lang") -> DataFrame:
    """doc_id, text_hash, owner, repo and the candidates of every row, in one pass without a shuffle.

    A repository is one value of ``repository`` of one owner; a null owner is an owner of its own.
    """
    text = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repo"),
    )
    found = text.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        "owner",
        "repo",
        _located("text", ASSIGN, 0).alias("assign"),
        _located("text", ACCESS, 1).alias("access"),
        _located("text", HEX, 2).alias("hex"),
        _located("text", LOOSE, 3).alias("loose"),
    )
    long = F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    mixed = F.filter(
        "loose", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & ~s["value"].rlike("^[0-9a-f]+$")
    )

    def marked(assign: Column) -> Column:
        """All spans; ``clear`` marks loose ones that overlap no base span.

        A run of loose characters holds an access or hex span whole or not at all, so its own
        characters tell; spans of assignments reach over its ends.
        """
        apart = F.transform(
            _clear_of(mixed, assign),
            lambda s: s.withField("clear", s["clear"] & ~s["value"].rlike(ACCESS) & ~s["value"].rlike(HEX)),
        )
        base = F.transform(F.concat(assign, "access", "hex"), lambda s: s.withField("clear", F.lit(True)))
        return F.concat(base, apart)

    hashed = F.transform(
        _let(long, marked),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            s["clear"].alias("clear"),
            F.sha2(_value(s["value"], s["kind"]), 256).alias("hash"),
        ),
    )
    return found.select("doc_id", "text_hash", "owner", "repo", hashed.alias("found"))


def scan(docs: DataFrame, *, owner: str = "source", repository: str = "lang", many: int = 3, few: int = 2) -> DataFrame:
    """doc_id, text_hash, base, found, n_copied, n_live: one row per row of ``docs``.

    ``base`` holds the base patterns' spans (start, kind, end) and ``found`` these and the strings
    that look live and overlap none of them: of one owner and at most ``few`` repositories.
    ``n_live`` counts base spans of that sort, ``n_copied`` those of ``many`` owners or more. Owners
    and repositories are made distinct before they are counted per hash, so a value that a third of
    all texts hold is a few rows by then. Null texts count as empty; repeated rows add no owner.
    """
    rows = staged(candidates(docs, owner=owner, repository=repository))
    each = rows.where(F.size("found") > 0).select("doc_id", "text_hash", "owner", "repo", F.explode("found").alias("s"))
    held = each.select(F.col("s.hash").alias("hash"), "owner", "repo").distinct()
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    stats = owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    judged = each.join(stats.withColumnRenamed("hash", "h"), F.col("s.hash") == F.col("h")).select(
        "doc_id",
        "text_hash",
        F.struct(
            F.col("s.start").alias("start"),
            F.col("s.kind").alias("kind"),
            F.col("s.end").alias("end"),
            ((F.col("owners") == 1) & (F.col("repos") <= few) & F.col("s.clear")).alias("live"),
            (F.col("owners") >= many).alias("copied"),
        ).alias("s"),
    )
    per_doc = judged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("all"))
    left = rows.select("doc_id", "text_hash").alias("l")
    right = per_doc.alias("r")
    joined = left.join(
        right,
        F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")),
        "left",
    ).select("l.doc_id", "l.text_hash", F.coalesce("r.all", F.expr("filter(array(r.all[0]), x -> false)")).alias("all"))
    span = "named_struct('start', s.start, 'kind', s.kind, 'end', s.end)"
    return joined.select(
        "doc_id",
        "text_hash",
        F.expr(f"transform(filter(all, s -> s.kind < 3), s -> {span})").alias("base"),
        F.expr(
            f"transform(filter(all, s -> s.kind < 3 or s.live), s -> {span})"
        ).alias("found"),
        F.expr("cast(size(filter(all, s -> s.kind < 3 and s.copied)) as long)").alias("n_copied"),
        F.expr("cast(size(filter(all, s -> s.kind < 3 and s.live)) as long)").alias("n_live"),
    )


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, spans by kind, base_sha256, spans, n_copied, n_live."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_spans("base").cast("binary"), 256).alias("base_sha256"),
        _spans("found").alias("spans"),
        "n_copied",
        "n_live",
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with ``mask`` in place of the sorted ``spans``, overlapping ones as one."""
    width = F.lit(CHUNK)

    def between(chunks: Column, first: Column, last: Column) -> Column:
        """Characters first to last - 1, taken from the chunks that hold them."""
        begin, end = _block(width, first), _block(width, last)
        return F.substring(F.array_join(F.slice(chunks, begin + 1, end - begin + 1), ""), first % CHUNK + 1, last - first)

    def assembled(v: Column) -> Column:
        def part(s: Column, at: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(between(v["chunks"], at, s["start"]), F.lit(mask))).otherwise("")

        parts = F.zip_with(v["spans"], _before(F.transform(v["spans"], lambda s: s["end"]), lambda a, b: F.greatest(a, b)), part)
        last = F.array_max(F.transform(v["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), between(v["chunks"], last, v["n"]))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    held = F.struct(chunks.alias("chunks"), F.array_sort(spans).alias("spans"), F.length(text).alias("n"))
    return _let(held, assembled)


def redact(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every span that ``scan`` finds replaced by ``mask`` and n_chars counted anew.

    Overlapping spans are masked as one. No row goes; null texts stay null and other columns, of
    any name, stay as they are.
    """
    found = scan(docs, **options).where(F.size("found") > 0).select("doc_id", "text_hash", "found").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    left = docs.select(row, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("l")
    joined = left.join(
        found.alias("r"),
        F.col("l.row.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")),
        "left",
    ).select("l.row", "r.found")
    text = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(_masked(F.col("row.text"), F.col("found"), mask))
    out = joined.select("row", "found", text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType.simpleString()
        new["n_chars"] = F.when(F.col("found").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(kind))
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
