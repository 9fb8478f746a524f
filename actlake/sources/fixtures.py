"""Stand-in inputs built from the supplied test tables.

Each builder only shapes rows into the schema a job expects (prompts,
completions, captured batches, stored vectors, an index); none of them does
a job's work, and no job relies on how these rows were made. Duplicates,
conflicts, decode batches, mismatched batches, cached prefixes, bad request
ids, short and zeroed sequences are planted here so the jobs meet them. Every
builder reads a whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


# The two runs and two layers of the stored-vector stand-in.
RUN_LAYERS = [("base", 16), ("base", 32), ("variant", 16), ("variant", 32)]
# Fixed value: tensor-parallel size of the capture stand-in.
CAPTURE_TP = 4
# The architecture registry order used to name an embedding's class.
ARCH_CLASS_BY_LABEL = [
    "Olmo2DecoderLayer",
    "LlamaDecoderLayer",
    "Qwen2DecoderLayer",
    "Qwen3DecoderLayer",
    "MistralDecoderLayer",
    "MixtralDecoderLayer",
    "DeciLMDecoderLayer",
]
# Ordering key for index rows appended by a re-run after the first pass.
RERUN_STRIDE = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Turns of one conversation are numbered below this.
TURNS = 1000


def prompts(spark, d) -> DataFrame:
    """Every user turn is a prompt."""
    return (table(spark, d, "conversations").where(F.col("role") == "user")
            .select((F.col("conv_id") * TURNS + F.col("turn")).alias("prompt_id"), F.col("text").alias("prompt")))


def completions(spark, d) -> DataFrame:
    """Every assistant turn is a rollout of the user turn before it; even prompts have each rollout again."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    x = table(spark, d, "conversations").withColumn("asked", asked).where((F.col("role") == "assistant") & F.col("asked").isNotNull())
    x = x.select((F.col("conv_id") * TURNS + F.col("asked")).alias("prompt_id"), "turn", "text")
    x = x.withColumn("again", F.explode(F.sequence(F.lit(0), (F.col("prompt_id") % 2 == 0).cast("int"))))
    n = F.row_number().over(Window.partitionBy("prompt_id").orderBy("again", "turn")) - 1
    return x.select("prompt_id", n.cast("int").alias("completion_idx"),
                    F.when(F.col("again") == 1, F.concat("text", F.lit(" (again)"))).otherwise(F.col("text")).alias("text"))


def system_prompts(spark, d) -> DataFrame:
    """The system turn of a conversation, for each of its prompts."""
    s = table(spark, d, "conversations").where((F.col("role") == "system") & (F.col("turn") == 0)) \
        .select(F.col("conv_id").alias("conv"), F.col("text").alias("system"))
    p = prompts(spark, d).select("prompt_id", F.floor(F.col("prompt_id") / TURNS).alias("conv"))
    return p.join(s, "conv").select("prompt_id", "system")


def prompts_clean(spark, d) -> DataFrame:
    """Two prompt "files": all prompts, and a repeat of some."""
    p = prompts(spark, d)
    return (p.select("prompt_id", "prompt", F.lit(0).alias("src_ord"))
            .unionByName(p.where(F.col("prompt_id") % 5 == 0).select("prompt_id", "prompt", F.lit(1).alias("src_ord"))))


def prompts_raw(spark, d) -> DataFrame:
    """``prompts_clean`` and a third "file" that conflicts."""
    return prompts_clean(spark, d).unionByName(
        prompts(spark, d).where(F.col("prompt_id") % 17 == 3)
        .select("prompt_id", F.concat("prompt", F.lit("!")).alias("prompt"), F.lit(2).alias("src_ord")))


def completions_raw(spark, d) -> DataFrame:
    """Two completion "files" with line order; the second (re-generated) must win."""
    c = completions(spark, d)
    line = (F.col("prompt_id") * 100 + F.col("completion_idx")).alias("line_ord")
    return (c.select("prompt_id", "completion_idx", "text", F.lit(0).alias("src_ord"), line)
            .unionByName(c.where(F.col("prompt_id") % 4 == 0)
                         .select("prompt_id", "completion_idx", F.concat(F.lit("v2: "), "text").alias("text"),
                                 F.lit(1).alias("src_ord"), line)))


def token_base(spark, d) -> DataFrame:
    """Token vectors: every embedding row, in blocks of 20 split into two
    sequences at a cut that varies by block (lengths 1 to 19)."""
    e = table(spark, d, "embeddings")
    blk = F.floor(F.col("vec_id") / 20).cast("bigint")
    pos = (F.col("vec_id") % 20).cast("int")
    cut = 1 + (blk * 7) % 19
    second = pos >= cut
    return e.select((blk * 2 + second.cast("bigint")).alias("prompt_id"),
                    (pos - F.when(second, cut).otherwise(F.lit(0))).cast("int").alias("token_pos"), "embedding")


def vectors(spark, d) -> DataFrame:
    """Stored vectors of two runs at two layers; the variant run lacks some
    prompts, is one token short on some and has zeroed token ranges."""
    b = token_base(spark, d).withColumn(
        "mx", F.max("token_pos").over(Window.partitionBy("prompt_id")))
    rl = F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(layer).alias("layer")) for r, layer in RUN_LAYERS])
    x = b.select("*", F.inline(rl))
    keep = (F.col("run_id") == "base") | ((F.col("prompt_id") % 11 != 5)
                                          & ~((F.col("prompt_id") % 7 == 3) & (F.col("token_pos") == F.col("mx"))))
    zero = F.transform("embedding", lambda v: F.lit(0.0).cast("float"))
    tvec = F.transform("embedding", lambda v: (v.cast("double") * 0.75 + 0.01).cast("float"))
    vec = (F.when((F.col("run_id") == "base") & (F.col("layer") == 16), F.col("embedding"))
           .when((F.col("run_id") == "variant") & (F.col("prompt_id") % 8 == 2)
                 & F.col("token_pos").between(2, 4), zero)
           .otherwise(tvec))
    return x.where(keep).select("run_id", F.col("layer").cast("int").alias("layer"), "prompt_id",
                                F.lit(0).alias("completion_idx"), "token_pos", vec.alias("vec"))


# Request ids of the planted empty sequences start here.
EMPTY_PROMPT = 1_000_000_000


def capture_seqs(spark, d) -> DataFrame:
    """Captured batches in long form: one row per sequence of a batch. Two sequences are the rollouts of one
    prompt; some go on from a cached prefix, some request ids cannot be parsed, every fifth batch is a decode step, and
    behind every sixth sequence stands an empty one with a request id of its own."""
    tb = token_base(spark, d)
    q = tb.groupBy("prompt_id").agg((F.max("token_pos") + 1).cast("int").alias("n"))
    q = q.withColumn("empty", F.explode(F.sequence(F.lit(0), (F.col("prompt_id") % 6 == 1).cast("int"))))
    q = q.withColumn("batch_id", F.floor(F.col("prompt_id") / 4).cast("bigint"))
    w = Window.partitionBy("batch_id").orderBy("prompt_id", "empty")
    pair = F.concat(F.floor(F.col("prompt_id") / 2).cast("string"), F.lit("|"), (F.col("prompt_id") % 2).cast("string"))
    return q.select(
        "batch_id",
        (F.row_number().over(w) - 1).cast("int").alias("seq_ord"),
        F.when(F.col("empty") == 1, F.concat((F.col("prompt_id") + EMPTY_PROMPT).cast("string"), F.lit("|0")))
         .when(F.col("prompt_id") % 10 == 9, F.lit("warmup")).otherwise(pair).alias("rid"),
        F.when(F.col("batch_id") % 5 == 4, F.lit(None).cast("int")).when(F.col("empty") == 1, F.lit(0)).otherwise(F.col("n")).alias("seq_len"),
        F.when(F.col("prompt_id") % 10 == 3, F.lit(4)).when(F.col("prompt_id") % 10 == 9, F.lit(2)).otherwise(F.lit(0)).alias("prefix_len"),
        (F.col("batch_id") % 8).alias("gpu_id"),
        (F.col("batch_id") % 4).alias("global_rank"))


def capture_tokens(spark, d) -> DataFrame:
    """The flattened hidden states of each captured batch, one row per token of ``token_base``."""
    tb = token_base(spark, d).withColumn("batch_id", F.floor(F.col("prompt_id") / 4).cast("bigint"))
    w = Window.partitionBy("batch_id").orderBy("prompt_id", "token_pos")
    return tb.select("batch_id", (F.row_number().over(w) - 1).cast("int").alias("flat_pos"), F.col("embedding").alias("vec"))


def capture_batches(spark, d) -> DataFrame:
    """Per-batch metadata arrays (the engine's view of one forward); some batches report one request id too few."""
    from ..operators.demux import batch_metadata
    m = batch_metadata(capture_seqs(spark, d))
    return m.withColumn("rids", F.when(F.col("batch_id") % 7 == 5, F.slice("rids", 1, F.size("rids") - 1)).otherwise(F.col("rids")))


def replica_rows(spark, d) -> DataFrame:
    """Two data-parallel replicas: they capture the same rollout of even prompts, and different ones of the others."""
    tb = token_base(spark, d).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("dp_rank"))
    return tb.select(F.lit("run").alias("run_id"), "prompt_id", ((F.col("prompt_id") % 2) * F.col("dp_rank")).cast("int").alias("completion_idx"),
                     "token_pos", F.lit(16).alias("layer"), "dp_rank", F.col("embedding").alias("vec"))


def doc_index(spark, d) -> DataFrame:
    """A sequence index over the documents at two layers, with re-run duplicates."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("prompt_id"), F.regexp_count("text", F.lit(r"\S+")).cast("int").alias("n_tokens"))
    q = (docs.withColumn("rerun", F.lit(0))
         .unionByName(docs.where(F.col("prompt_id") % 50 == 7).withColumn("rerun", F.lit(1))))
    return q.select("prompt_id", F.lit(0).alias("completion_idx"),
                    F.explode(F.array(F.lit(16), F.lit(32))).alias("layer"), "n_tokens",
                    (F.col("rerun") * F.lit(RERUN_STRIDE) + F.col("prompt_id")).alias("append_ord"))


def directions_raw(spark, d) -> DataFrame:
    """Steering directions keyed like a tensor file: ``layer_<n>`` plus other keys."""
    e = table(spark, d, "embeddings")
    key = (F.when(F.col("label") == 8, F.concat(F.lit("layer_x"), F.col("vec_id").cast("string")))
           .when(F.col("label") == 9, F.concat(F.lit("other_"), F.col("vec_id").cast("string")))
           .otherwise(F.concat(F.lit("layer_"), F.col("vec_id").cast("string"))))
    return e.select(key.alias("key"), F.col("embedding").alias("vec"))


def arch_states(spark, d) -> DataFrame:
    """A layer's outputs: ``h`` and a residual ``r`` per row, with its layer class."""
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("n"))
    names = F.array(*[F.lit(n) for n in ARCH_CLASS_BY_LABEL])
    cls = F.when(F.col("label") < len(ARCH_CLASS_BY_LABEL), F.element_at(names, F.col("label") + 1)) \
           .otherwise(F.concat(F.lit("UnknownDecoderLayer"), F.col("label").cast("string")))
    return e.join(nxt, "vec_id", "left").select("vec_id", cls.alias("layer_class"), F.col("embedding").alias("h"),
                                                F.coalesce("n", "embedding").alias("r"))


# Multipliers spreading document tokens over the embedding rows.
DOC_VEC_MUL = (7919, 104729)


#: The embeddings are broadcast in pieces of at most about so many bytes: a shuffle join would deal every token's vector by vec_id.
#: A piece's rows then fit a page of 64 MB of Spark's hash table, which grows by doubling.
VEC_PIECE = 56 << 20


def doc_words(spark, d) -> DataFrame:
    """Number of words and bytes of every document."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("prompt_id"), F.regexp_count("text", F.lit(r"\S+")).cast("int").alias("n"),
                                               F.octet_length("text").alias("n_bytes"))


def _spread(docs: DataFrame, key: str) -> DataFrame:
    """Documents dealt out by ``key`` before their tokens are made, so that no token row is shuffled: about 250k
    tokens per partition, at least the cluster's parallelism and Spark's number of shuffle partitions, which a join by the key then keeps."""
    spark = docs.sparkSession
    total = docs.agg(F.sum("n")).collect()[0][0] or 0
    par = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.repartition(int(max(par, -(-total // 250_000))), key)


def _with_vectors(spark, d, tokens: DataFrame) -> DataFrame:
    """``tokens`` (prompt_id, token_pos, ...) with a 64-float vector taken from the embeddings. Whatever the size of the embeddings no token is
    shuffled: each piece of them is broadcast and joined with the tokens that take a vector of it, where these are, and the
    union keeps the partitioning of ``tokens``."""
    emb = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n_emb, size = emb.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(16) + F.size("vec") * F.lit(4)), F.lit(0))).first()
    t = tokens.withColumn("vec_id", F.pmod(F.col("prompt_id") * DOC_VEC_MUL[0] + F.col("token_pos") * DOC_VEC_MUL[1],
                                           F.lit(n_emb)))
    k = max(1, -(-size // VEC_PIECE))
    if k == 1:
        return t.join(F.broadcast(emb), "vec_id")
    piece = F.pmod(F.xxhash64(F.col("vec_id").cast("bigint")), F.lit(k))
    return reduce(DataFrame.unionAll, [t.where(piece == i).join(F.broadcast(emb.where(piece == i)), "vec_id") for i in range(k)])


def doc_width(spark, d) -> int:
    """Elements of the widest vector of ``doc_tokens``."""
    return table(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0


def doc_tokens(spark, d, words: DataFrame | None = None, n_parts: int | None = None) -> DataFrame:
    """One token row per word of every document, with a 64-float vector taken
    from the embeddings (a stored run at document scale). ``words``: ``doc_words`` where it is stored already;
    ``n_parts``: partitions by ``prompt_id``, otherwise as many as the tokens need."""
    docs = (doc_words(spark, d) if words is None else words).select("prompt_id", "n").where(F.col("n") > 0)
    docs = _spread(docs, "prompt_id") if n_parts is None else docs.repartition(n_parts, "prompt_id")
    t = docs.select("prompt_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("token_pos"))
    return _with_vectors(spark, d, t).select("prompt_id", F.lit(0).alias("completion_idx"), "token_pos", "vec")


# Documents per captured batch of the document-scale capture.
DOC_BATCH = 4


def doc_capture(spark, d) -> tuple[DataFrame, DataFrame]:
    """Document tokens as captured batches: (tokens, batch metadata), both dealt out by batch, so that their join shuffles no vector.
    Tokens of documents with one id take the offset of each of them."""
    docs = doc_words(spark, d).select("prompt_id", "n").withColumn("batch_id", F.floor(F.col("prompt_id") / DOC_BATCH).cast("bigint"))
    docs = _spread(docs, "batch_id")
    w = Window.partitionBy("batch_id").orderBy("prompt_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))
    seqs = docs.select("batch_id", (F.row_number().over(Window.partitionBy("batch_id").orderBy("prompt_id")) - 1)
                       .cast("int").alias("seq_ord"),
                       F.concat(F.col("prompt_id").cast("string"), F.lit("|0")).alias("rid"),
                       F.col("n").alias("seq_len"), F.lit(0).alias("prefix_len"),
                       F.lit(0).cast("bigint").alias("gpu_id"), F.lit(0).cast("bigint").alias("global_rank"))
    from ..operators.demux import batch_metadata
    meta = batch_metadata(seqs)
    t = docs.withColumn("offsets", F.collect_list("offset").over(Window.partitionBy("batch_id", "prompt_id"))).where(F.col("n") > 0)
    t = t.select("prompt_id", "batch_id", "n", F.explode("offsets").alias("offset")) \
        .select("prompt_id", "batch_id", "offset", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("token_pos"))
    toks = _with_vectors(spark, d, t)
    return toks.select("batch_id", (F.col("offset") + F.col("token_pos")).cast("int").alias("flat_pos"), "vec"), meta


def odd_vectors(spark, d) -> DataFrame:
    """``vectors`` of two runs that are hard to compare: some sequences are equal, some hold a NaN in one run, and in some the
    runs have different widths."""
    v = vectors(spark, d).where(F.col("layer") == 16)
    base = v.where(F.col("run_id") == "base")
    pid, first = F.col("prompt_id"), F.col("token_pos") == 0
    nan = F.transform("vec", lambda x, i: F.when(i == 0, F.lit(float("nan")).cast("float")).otherwise(x))
    short = F.slice("vec", 1, 32)
    moved = F.transform("vec", lambda x: (x.cast("double") * 0.75 + 0.01).cast("float"))
    vec = (F.when((pid % 4 == 1) & first, nan).when(pid % 4 == 2, moved).when(pid % 4 == 3, short).otherwise(F.col("vec")))
    return base.unionByName(base.withColumn("run_id", F.lit("odd")).withColumn("vec", vec))
