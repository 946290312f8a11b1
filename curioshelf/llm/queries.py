"""One query for each operator of this subpackage, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curioshelf.session import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@query(
    "op1_ngram_jaccard_join",
    f"""
    with recursive words as materialized (select doc_id, {WORDS} w from documents),
    sets as materialized (
      select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from words),
    flat as materialized (select doc_id, len(s) n, unnest(s) g from sets),
    pairs as (select x.doc_id a, y.doc_id b, x.n na, y.n nb, count(*) met
      from flat x join flat y on x.g = y.g and x.doc_id <> y.doc_id group by all),
    links as materialized (select a, b from pairs where 100 * met >= 75 * (na + nb - met)),
    reach(id, root) as (select doc_id, doc_id from sets union select r.id, l.b from reach r join links l on l.a = r.root)
    select doc_id, len(s)::bigint n_shingles, root component_id
    from sets join (select id, min(root) root from reach group by id) on id = doc_id
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curioshelf.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curioshelf.llm import secrets

    scanned = kept(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    scored = secrets.score(scanned, secrets.train(secrets.samples(scanned)))
    count = lambda kind: F.size(f"_{kind}").cast("long").alias(f"n_{kind}")
    return scored.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.listed("_base"), 256).alias("base_sha256"),
        secrets.listed("_spans").alias("spans"),
    )


PLANTED_CONVERSATION = -7
PLANTED_TEXT = "\\### Assistant: </turn> ok"


@query(
    "op10_chat_formatting",
    f"""
    with rows as (select conv_id, turn, coalesce(role, '') r, role, coalesce(text, '') t from conversations
      union all values ({PLANTED_CONVERSATION}, 0, 'user', 'user', '{PLANTED_TEXT}'), ({PLANTED_CONVERSATION}, 1, 'assistant', 'assistant', '{PLANTED_TEXT}')),
    esc as (select *, length(replace(replace(replace(t, '\\', '\\b'), '<', '\\l'), '#', '\\h')) nt,
      length(replace(replace(replace(replace(r, '\\', '\\b'), '<', '\\l'), '#', '\\h'), ':', '\\c')) nr from rows)
    select conv_id, count(*) n_turns,
      sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, role, t)) turns_sha256,
      coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint loss_chars,
      sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (role = 'assistant'), '')) loss_sha256,
      sum(nr + nt + 15)::bigint formatted_chars
    from esc group by conv_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curioshelf.llm import chat

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(PLANTED_CONVERSATION, n, role, PLANTED_TEXT) for n, role in enumerate(("user", "assistant"))]
    planted = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.format_chats(chat.as_events(given.unionByName(planted))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op8_topk_nra",
    """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
    select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
    from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curioshelf.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


@query("op4_bottom_k_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curioshelf.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query("op3_token_file")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from curioshelf.llm.token_files import token_file

    return token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def held_out(parts: int, left: int) -> F.Column:
    """Whether a row is kept from training: by the checksum of its doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % parts == left


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curioshelf.llm import toxicity

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels.where(~held_out(4, 2)))
    scored = toxicity.score(documents, model)
    score = F.col("toxicity_score")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op5_line_crf_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curioshelf.llm import line_crf

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = line_crf.train(documents, labels.where(~held_out(5, 0)))
    scored = line_crf.score(documents, model)
    score = F.col("quality_score")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), score.alias("score"), (score >= line_crf.THRESHOLD).cast("int").alias("predicted"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curioshelf.llm.packing import near_items, pack

    return pack(near_items(table(spark, sf_dir, "documents")))


@query("op2_piece_lattice")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from curioshelf.llm.piece_lattice import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _code_rounds(rounds: int) -> str:
    """Of the SQL of op12: assignments and codebooks, round by round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} as (select v.vec_id, v.p, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d
          from parts v join c{r} c on c.p = v.p),
        a{r} as materialized (select * from d{r} qualify row_number() over (partition by vec_id, p order by d, k) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} as (select p, k, i, sum(x[i]::hugeint) s, count(*) n from a{r}, range(1, (select max(len(x)) from parts) + 1) t(i) group by all),
        f{r} as (select p, k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) x from m{r} group by all),
        c{r + 1} as materialized (select c.p, c.k, coalesce(f.x, c.x) x from c{r} c left join f{r} f on f.p = c.p and f.k = c.k)""")
    return ",\n        ".join(steps)


@query(
    "op12_vector_codes",
    f"""
    with v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) e from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    parts as materialized (select vec_id, p, e[p * (len(e) // 8) + 1 : (p + 1) * (len(e) // 8)] x from v, range(8) t(p)),
    c0 as materialized (select p, k, x from parts join (select vec_id, row_number() over (order by vec_id) - 1 k from v order by vec_id limit 16) using (vec_id)),
        {_code_rounds(6)},
    coded as (select vec_id, string_agg(printf('%02x', k::int), '' order by p) code, sum(d)::bigint error from a6 group by vec_id)
    select vec_id, code, error, sum(error) over (partition by label)::bigint label_error,
      (select sha256(string_agg(array_to_string(x, ','), ',' order by p, k)) from c6) codebooks_sha256
    from coded join v using (vec_id)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curioshelf.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from curioshelf.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar) || ':' || {value}::varchar end"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# Checksum of the decimal doc_id, bit by bit: eight steps for each byte.
_BYTE = "(case when i % 8 = 0 then xor(c, ascii(substr(doc_id::varchar, i // 8 + 1, 1))::bigint) else c end)"
_CRC = f"xor(list_reduce([4294967295::bigint] || range(8 * strlen(doc_id::varchar)), lambda c, i: xor({_BYTE} >> 1, case when {_BYTE} % 2 = 1 then 3988292384::bigint else 0 end)), 4294967295::bigint)"


def _tree(name: str, leaves: str) -> str:
    """Of the SQL of op11: levels of trees over ``leaves`` (tree, pos, h), with each node's siblings."""
    around = "partition by tree, lvl, pos // 16 order by pos rows between"
    return f"""{name}_up as (
      select tree, 0::bigint lvl, pos, h, count(*) over (partition by tree) n from {leaves}
      union all
      select tree, lvl + 1, pos // 16, sha256(string_agg(h, '' order by pos)), (n + 15) // 16 from {name}_up where n > 1 group by tree, lvl, pos // 16, n),
    {name} as materialized (select *, coalesce(string_agg(h, '') over ({around} unbounded preceding and 1 preceding), '') l,
      coalesce(string_agg(h, '') over ({around} 1 following and unbounded following), '') r from {name}_up)"""


@query(
    "op11_merkle_manifest",
    f"""
    with recursive hashed as materialized (select doc_id, source, {_leaf("text")} leaf,
      case when doc_id is not null and {_CRC} % 5 = 0 then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end bad from documents),
    leaves as materialized (select *, case when source is null then '-' else '=' || source end tree,
      row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos from hashed),
    {_tree("low", "(select tree, pos, leaf h from leaves)")},
    subs as materialized (select tree src, h sub, lvl depth, row_number() over (order by tree) - 1 pos from low where n = 1),
    {_tree("high", "(select '' tree, pos, sub h from subs)")},
    steps as materialized (
      select tree, lvl, pos, l, r, n, false top from low where n > 1
      union all select src, depth + lvl, high.pos, l, r, n, true from high join subs on subs.pos // (16 ** lvl)::bigint = high.pos where n > 1),
    walk as (
      select tree, pos start, pos, 0::bigint lvl, coalesce(bad, leaf) h, leaf, doc_id, '' proof from leaves
      union all
      select w.tree, w.start, s.pos // 16, s.lvl + 1, sha256(s.l || w.h || s.r), w.leaf, w.doc_id, w.proof || s.l || s.r
      from walk w join steps s on s.tree = w.tree and s.lvl = w.lvl and (s.top or s.pos = w.pos)),
    ends as (select * from walk qualify row_number() over (partition by tree, start order by lvl desc) = 1),
    told as (select doc_id, leaf, sub subroot, (select h from high where n = 1) root, sha256(proof) proof_sha256, e.h folded_root
      from ends e join subs on src = e.tree)
    select *, folded_root = root verified from told
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curioshelf.llm.merkle import manifest, tampered

    documents = table(spark, sf_dir, "documents")
    return manifest(documents, tampered(documents))
