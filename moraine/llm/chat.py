"""Operator 6: chat formatting in budgeted windows, with DataFrame functions only.

A turn is ``<|turn|>role`` newline text ``<|end|>`` newline.  Control strings inside roles and texts are escaped with
one escape character, reversibly.  A turn above half the budget is cut in pieces that end in ``<|more|>`` newline and go
on after ``<|cont|>``; reading joins them again.

Tokens are estimated as UTF-8 bytes of the formatted text / ``BYTES_PER_TOKEN``, rounded up.  Prefix sums of these over a
conversation choose turn-aligned spans: of the budget the repeated system turn, the history budget and the conversation's
longest piece are set aside, and a piece belongs to the span in whose share of the prefix sum it begins.  So no window
exceeds ``budget`` (but for roles of thousands of bytes, which aren't cut), and nothing has to fold a conversation.

Each window after the first repeats the leading system turn, if it takes a quarter of the budget at most (a longer one
stands in its own windows only), and up to ``history_turns`` pieces before its span, as far as they fit in
``history_budget`` (a quarter of the budget at most).  ``loss`` marks the assistant texts of the span itself: repeated
turns are masked, so each target counts once.

Defined results: turns go by (turn, role, text), nulls first; null roles and texts are empty; repeated rows are turns
each; a null conv_id is a conversation of its own; an empty table gives no window; extra columns are ignored.
Windows of a conversation are made in the task of its conv_id, streaming and with spills; only ``digests`` gathers a
conversation in one row, as its digests need the whole of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 4
BUDGET, HISTORY_BUDGET, HISTORY_TURNS = 1024, 256, 2
OPEN, CONT, MORE, END = "<|turn|>", "<|cont|>", "<|more|>\n", "<|end|>\n"
#: The escape character, and the letter after it that stands for each control string: fixed values of the format.
ESCAPE = "␛"
CONTROL = {"<|": "p", "[INST]": "i", "[/INST]": "j", "<<SYS>>": "y", "<</SYS>>": "z", "<s>": "s", "</s>": "t"}


def escape(text: Column, newline: bool = False) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e"))
    for control, letter in {**CONTROL, **({"\n": "n"} if newline else {})}.items():
        out = F.replace(out, F.lit(control), F.lit(ESCAPE + letter))
    return out


def unescape(text: Column) -> Column:
    for control, letter in {**CONTROL, "\n": "n"}.items():
        text = F.replace(text, F.lit(ESCAPE + letter), F.lit(control))
    return F.replace(text, F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN)


def _pieces(turns: DataFrame, limit: int) -> DataFrame:
    """Turns (conv_id, i, role, text, target) as formatted pieces of at most ``limit`` tokens."""
    # a code point takes at most four bytes once it is escaped, or one where the whole text takes one each
    head = _tokens(F.concat(F.lit(OPEN), F.col("role"), F.lit("\n" + MORE)))
    least = F.when(F.octet_length(escape(F.col("text"))) == F.length("text"), BYTES_PER_TOKEN).otherwise(1)
    step = F.greatest(F.lit(limit) - head, F.lit(8)).cast("int") * least
    cut = F.regexp_extract_all("text", F.concat(F.lit("(?s).{1,"), step.cast("string"), F.lit("}")), F.lit(0))
    parts = F.when(F.length("text") > step, cut).otherwise(F.array("text"))
    cuts = turns.withColumn("parts", parts).select("conv_id", "i", "role", "target", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "piece"))
    begin = F.when(F.col("part") == 0, F.concat(F.lit(OPEN), "role", F.lit("\n"))).otherwise(F.lit(CONT))
    end = F.when(F.col("part") == F.col("n") - 1, F.lit(END)).otherwise(F.lit(MORE))
    system = (F.col("i") == 1) & (F.col("role") == "system") & (F.col("n") == 1)
    cuts = cuts.select("conv_id", "i", "part", "target", system.alias("system"), F.length(begin).alias("lead"), F.length(end).alias("tail"), F.concat(begin, escape(F.col("piece")), end).alias("said"))
    return cuts.withColumn("tokens", _tokens(F.col("said")))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history_budget: int = HISTORY_BUDGET, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """``(conv_id, window, formatted, n_repeated, loss)``: ``loss`` holds (begin, end) code points, end exclusive."""
    if budget < 64:
        raise ValueError("a budget below 64 tokens has no room for the template")
    history_budget = min(history_budget, budget // 4)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", "turn", "role", "text").withColumn("i", F.row_number().over(order))
    turns = turns.select("conv_id", "i", escape(F.coalesce("role", F.lit("")), newline=True).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("target"))
    pieces = _pieces(turns, budget // 2)
    whole, so_far = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("i", "part")
    held = F.col("system") & (F.col("tokens") <= budget // 4)
    pieces = pieces.withColumn("held", held).withColumn("upto", F.sum("tokens").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = pieces.withColumn("longest", F.max("tokens").over(whole)).withColumn("first", F.max(F.when(F.col("held"), F.struct("tokens", "said"))).over(whole))
    share = F.greatest(F.lit(budget - history_budget + 1) - F.coalesce(F.col("first.tokens"), F.lit(0)) - F.col("longest"), F.lit(1))
    pieces = pieces.withColumn("span", F.floor((F.col("upto") - F.col("tokens")) / share))
    new = F.col("span") != F.lag("span").over(so_far)
    pieces = pieces.withColumn("new", F.coalesce(new, F.lit(True)))
    again, spent = F.array().cast("array<string>"), F.lit(0)
    for k in range(1, history_turns + 1):  # from the nearest piece back, while they fit
        said, tokens, system = (F.lag(c, k).over(so_far) for c in ("said", "tokens", "held"))
        spent = spent + tokens
        again = F.when((F.size(again) == k - 1) & (spent <= history_budget) & ~system, F.concat(F.array(said), again)).otherwise(again)
    held = F.when(F.col("first").isNotNull(), F.array("first.said")).otherwise(F.array().cast("array<string>"))
    pieces = pieces.withColumn("again", F.when(F.col("new") & (F.col("span") > 0), F.concat(held, again)))
    windows = pieces.groupBy("conv_id", "span").agg(
        F.sort_array(F.collect_list(F.struct("i", "part", "said", "lead", "tail", "target"))).alias("own"), F.max("again").alias("again")
    )
    windows = windows.withColumn("again", F.coalesce("again", F.array().cast("array<string>")))
    windows = windows.withColumn("window", F.row_number().over(Window.partitionBy("conv_id").orderBy("span")) - 1).withColumn("head", F.array_join("again", ""))
    start = F.struct(F.length("head").alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("loss"))

    def mark(acc, piece):
        end = acc["at"] + F.length(piece["said"])
        span = F.struct((acc["at"] + piece["lead"]).alias("begin"), (end - piece["tail"]).alias("end"))
        return F.struct(end.alias("at"), F.when(piece["target"], F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"]).alias("loss"))

    formatted = F.concat("head", F.array_join("own.said", ""))
    return windows.select("conv_id", "window", formatted.alias("formatted"), F.size("again").alias("n_repeated"), F.aggregate("own", start, mark)["loss"].alias("loss"))


def read_pieces(formatted: Column) -> Column:
    """The pieces of a window, unescaped: array of (whether it goes on with a turn, role, text, whether the turn goes on)."""
    parts = F.split(formatted, "(?<=<\\|(?:end|more)\\|>\n)", -1)

    def piece(part):
        goes_on = F.endswith(part, F.lit(MORE))
        cont = F.startswith(part, F.lit(CONT))
        body = F.substr(part, F.lit(len(OPEN) + 1), F.length(part) - len(OPEN) - F.when(goes_on, len(MORE)).otherwise(len(END)))
        cut = F.when(cont, 0).otherwise(F.position(F.lit("\n"), body))
        return F.struct(
            cont.alias("cont"), F.when(cont, "").otherwise(unescape(F.substr(body, F.lit(1), cut - 1))).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"), goes_on.alias("more")
        )

    return F.transform(F.filter(parts, lambda p: p != ""), piece)


def op6_budgeted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(format_windows(conversations.unionByName(probe)))


def digests(windows: DataFrame) -> DataFrame:
    """What is read back from formatted windows, per conversation."""
    own = F.slice(F.col("all"), F.col("n_repeated") + 1, F.size("all") - F.col("n_repeated"))
    loss = F.transform("loss", lambda s: unescape(F.substr("formatted", s["begin"] + 1, s["end"] - s["begin"])))
    said = F.transform(own, lambda t: F.concat(F.when(t["cont"], "").otherwise(F.concat(t["role"], F.lit("\n"))), t["text"], F.when(t["more"], "").otherwise("\n")))
    read = windows.withColumn("all", read_pieces(F.col("formatted"))).select(
        "conv_id", "window", F.size(F.filter(own, lambda t: ~t["cont"])).alias("n"), F.length("formatted").alias("chars"), F.array_join(said, "").alias("said"), F.array_join(loss, "").alias("learnt")
    )
    conv = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "said", "learnt"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    said, learnt = F.array_join("w.said", ""), F.array_join("w.learnt", "")
    return conv.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars"
    )


def _sql_escape(text: str) -> str:
    for control, letter in {ESCAPE: "e", **CONTROL}.items():
        text = f"replace({text}, '{control}', '{ESCAPE}{letter}')"
    return text


#: Template and escapes are the values above; budgets 1024, 512 a piece, 256 the system turn, 256 and two pieces of history.
OP6_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, x, CASE x WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS t(x)),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
  coalesce(role, '') AS raw, replace({_sql_escape("coalesce(role, '')")}, chr(10), '{ESCAPE}n') AS role, coalesce(text, '') AS text FROM c),
w AS (SELECT *, CAST(greatest(512 - ceil((strlen(role) + 18) / 4.0), 8) AS BIGINT) * CASE WHEN strlen({_sql_escape("text")}) = length(text) THEN 4 ELSE 1 END AS step FROM t),
n AS (SELECT *, CAST(greatest(ceil(length(text) / CAST(step AS DOUBLE)), 1) AS BIGINT) AS n FROM w),
p AS (SELECT conv_id, i, role, n, step, text, unnest(range(n)) AS part FROM n),
q AS (SELECT conv_id, i, part, i = 1 AND role = 'system' AND n = 1 AS system,
  CASE WHEN part = 0 THEN '{OPEN}' || role || chr(10) ELSE '{CONT}' END || {_sql_escape("substr(text, part * step + 1, step)")} || CASE WHEN part = n - 1 THEN '<|end|>' ELSE '<|more|>' END || chr(10) AS said FROM p),
k AS (SELECT *, CAST(ceil(strlen(said) / 4.0) AS BIGINT) AS tokens, length(said) AS chars FROM q),
h AS (SELECT *, system AND tokens <= 256 AS held, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i, part ROWS UNBOUNDED PRECEDING) AS upto, max(tokens) OVER (PARTITION BY conv_id) AS longest,
  coalesce(max(CASE WHEN system AND tokens <= 256 THEN tokens END) OVER (PARTITION BY conv_id), 0) AS first_tokens,
  coalesce(max(CASE WHEN system AND tokens <= 256 THEN chars END) OVER (PARTITION BY conv_id), 0) AS first_chars FROM k),
s AS (SELECT *, (upto - tokens) // greatest(769 - first_tokens - longest, 1) AS span FROM h),
l AS (SELECT *, lag(span) OVER o AS before, lag(tokens) OVER o AS t1, lag(tokens, 2) OVER o AS t2, lag(chars) OVER o AS c1, lag(chars, 2) OVER o AS c2, lag(held) OVER o AS h1, lag(held, 2) OVER o AS h2
  FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY i, part)),
f AS (SELECT conv_id, chars + CASE WHEN span > 0 AND span <> before THEN first_chars + CASE WHEN NOT h1 AND t1 <= 256 THEN c1 + CASE WHEN NOT h2 AND t1 + t2 <= 256 THEN c2 ELSE 0 END ELSE 0 END ELSE 0 END AS chars FROM l),
z AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, string_agg(raw || chr(10) || text || chr(10), '' ORDER BY i) AS said, coalesce(string_agg(text, '' ORDER BY i) FILTER (raw = 'assistant'), '') AS learnt FROM t GROUP BY conv_id)
SELECT d.conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM d JOIN z ON d.conv_id IS NOT DISTINCT FROM z.conv_id
"""
