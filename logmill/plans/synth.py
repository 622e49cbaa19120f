"""Log corpora derived from the given tables, written in SQL that Spark and DuckDB both read.

A log document in one row holds the events of one owner in one week, an order document the orders of one
customer in one year: a natural bound, so an owner with a large share of all rows has many documents. Its id
is the owner times a million plus the week or year, which stays below that. ``owner_lines`` has all events of
an owner as one document, in the form of a line table: no row holds more than one event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logmill.operators.line_prepare import raw_lines
from logmill.operators.ordering import running_sum
from logmill.session import written

#: Event ids of a range: an owner's events are far apart, so smaller ranges hold a few events each.
EVENT_RANGE = 1 << 18

STYLES = (
    "broker", "journal", "cloud", "flow", "access", "build", "compiler", "prose", "trace",
)

EVENT_COLUMNS = """
  event_id, user_id, event_type,
  cast(floor(value * 100) as bigint) as cents,
  cast({k} as bigint) as k,
  {ts} as ts,
  case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end as level,
  case event_type when 'error' then '3' when 'signup' then '4' else '6' end as priority,
  case event_id % 6 when 0 then 200 when 1 then 301 when 2 then 404 when 3 then 500
    when 4 then 204 else 200 end as status,
  {doc_id} as doc_id
"""

# One source row to one or more log lines, by style.
LINES = {
    "broker": """concat('[', ts, '] ', level, ' [Broker id=', user_id, '] ', event_type, ' value ',
  cents, case when k % 5 = 0 then concat(' token=t', k, 'x Bearer b', k) else '' end,
  ' (kafka.server.KafkaApis)', case when k % 3 = 0 then concat(chr(9), ' ') else '' end,
  case when event_type = 'error'
    then concat(chr(13), chr(10), chr(9), 'at kafka.server.Frame(Frame.scala:', k, ')') else '' end)""",
    "journal": """concat('{{"__REALTIME_TIMESTAMP":"', 1704067200 + event_id, '","PRIORITY":"', priority,
  '","_SYSTEMD_UNIT":"svc', user_id % 10, '.service","MESSAGE":"', event_type, ' value ', cents, '"}}')""",
    "cloud": """case event_id % 4
  when 0 then concat('{{"insertId":"', event_id, '","timestamp":"', ts, '","severity":"INFO","httpRequest":{{"requestMethod":"GET","requestUrl":"/', event_type, '","status":', status, '}}}}')
  when 1 then concat('{{"insertId":"', event_id, '","timestamp":"', ts, '","protoPayload":{{"serviceName":"store.example","methodName":"', event_type, '","status":{{"code":', k % 3, ',"message":"m', k, '"}}}}}}')
  when 2 then concat('{{"insertId":"', event_id, '","timestamp":"', ts, '","textPayload":"', event_type, ' request ', status, ' done"}}')
  else concat('{{"insertId":"', event_id, '","jsonPayload":{{"message":"', event_type, case when k % 2 = 0 then ' failed ' else ' passed ' end, cents, '","level":null}}}}') end""",
    "flow": """case when event_id % 20 = 7 then concat('short line ', event_id) else
  concat('2 123456789012 eni-', user_id, 'a 10.0.0.', user_id % 250, ' 10.0.1.', k, ' ', 1024 + k,
  ' 443 6 ', k, ' ', cents, ' ', 1704067200 + event_id, ' ', 1704067260 + event_id, ' ',
  case event_id % 5 when 0 then 'REJECT OK' when 1 then '- NODATA' when 2 then '- SKIPDATA'
    else 'ACCEPT OK' end) end""",
    "access": """concat('10.0.0.', user_id % 250, ' - - [', ts, '] "GET /', event_type, ' HTTP/1.1" ',
  status, ' ', cents)""",
    "build": """case when event_type = 'error'
  then concat('#', event_id, ' ERROR: process ended: exit code: ', k)
  else concat('#', event_id, ' [', k, '/100] RUN step ', event_type) end""",
    "compiler": """case when event_type = 'error'
  then concat('error[E0', 100 + k, ']: mismatched value ', cents, chr(10), '  --> src/main.rs:', k, ':1', chr(10), '   |')
  else concat('warning: unused ', event_type) end""",
    "prose": """concat(event_type, ' happened with value ', cents,
  case when k % 4 = 0 then concat(' password=p', k, ' again password=q') else '' end)""",
}
LINES["trace"] = """concat('  File "app.py", line ', k, ', in ', event_type)"""
SEPARATORS = {"broker": "concat(chr(13), chr(10))", "cloud": "concat(',', chr(10))"}
HEADS = {
    "cloud": "'['",
    "compiler": "concat('   Compiling app v0.1.0', chr(10))",
    "build": "concat('#0 load build definition', chr(10))",
    "trace": "concat('Traceback (most recent call last):', chr(10))",
}
TAILS = {
    "cloud": "']'",
    "compiler": "concat(chr(10), 'error[E0308]: last', chr(10), ' --> src/lib.rs:1:1')",
    "build": "concat(chr(10), 'ERROR: failed to solve: image')",
    "trace": "concat(chr(10), 'ValueError: bad value')",
}


def _dialect(engine: str) -> dict:
    if engine == "spark":
        return {
            "k": r"regexp_extract(props, '([0-9]+)', 1)",
            "ts": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
            "week": "datediff(cast(ts as date), date '1970-01-01') div 7",
            "table": "parquet.`{dir}/events.parquet`",
            "agg": "array_join(transform(array_sort(collect_list(struct(event_id, line))), x -> x.line), {sep})",
        }
    return {
        "k": r"regexp_extract(props, '([0-9]+)', 1)",
        "ts": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
        "week": "datediff('day', date '1970-01-01', cast(ts as date)) // 7",
        "table": "events",
        "agg": "string_agg(line, {sep} order by event_id)",
    }


def _parts(engine: str, style: str, by: str) -> dict[str, str]:
    """SQL of an event's columns, its line, its style and the head, separator and tail of its document."""
    d = _dialect(engine)
    doc_id = f"user_id * 1000000 + {d['week']}" if by == "week" else "user_id"
    lines = {name: text.replace("{{", "{").replace("}}", "}") for name, text in LINES.items()}

    def pick(parts: dict, default: str) -> str:
        if style != "mixed":
            return parts.get(style, default)
        cases = " ".join(f"when {i} then {parts.get(s, default)}" for i, s in enumerate(STYLES))
        return f"case style_no {cases} end"

    return {
        "columns": EVENT_COLUMNS.format(k=d["k"], ts=d["ts"], doc_id=doc_id),
        "number": f"user_id % {len(STYLES)}" if style == "mixed" else str(STYLES.index(style)),
        "line": pick(lines, "''"), "sep": pick(SEPARATORS, "chr(10)"), "head": pick(HEADS, "''"), "tail": pick(TAILS, "''"),
    }


def corpus_sql(engine: str, style: str = "mixed", sf_dir: str = "", by: str = "week") -> str:
    """SELECT of ``doc_id, name, style, text`` built from the events table, a document by owner and
    week or by owner.

    ``mixed`` gives every owner one of the styles.
    """
    d, p = _dialect(engine), _parts(engine, style, by)
    joined = d["agg"].format(sep=p["sep"])
    if engine != "spark":
        # string_agg wants a constant separator: join with a unit separator, then replace it.
        joined = f"replace({d['agg'].format(sep='chr(31)')}, chr(31), {p['sep']})"
    names = " ".join(f"when {i} then '{s}'" for i, s in enumerate(STYLES))
    return f"""
select doc_id, concat('log-', doc_id, '.log') as name, case style_no {names} end as style,
  concat({p['head']}, {joined}, {p['tail']}) as text
from (select doc_id, style_no, event_id, {p['line']} as line
      from (select {p['columns']}, {p['number']} as style_no from {d['table'].replace("{dir}", sf_dir)}))
group by doc_id, style_no
"""


def owner_lines(spark: SparkSession, sf_dir: str, style: str = "mixed") -> DataFrame:
    """The documents of ``corpus_sql(by="owner")`` as a line table, without ever joining their lines."""
    p = _parts("spark", style, "owner")
    table = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    rows = table.select(F.expr(f"struct({p['columns']}, {p['number']} as style_no)").alias("event")).select("event.*")
    events = rows.select("doc_id", "event_id", *[F.expr(p[name]).alias(name) for name in ("line", "sep", "head", "tail")])
    ends = events.groupBy("doc_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    text = F.concat(
        F.when(F.col("event_id") == F.col("first"), F.col("head")).otherwise(""), "line",
        F.when(F.col("event_id") == F.col("last"), F.col("tail")).otherwise(F.col("sep")),
    )
    pieces = raw_lines(events.join(ends, "doc_id").select(F.struct("doc_id", "event_id").alias("id"), text.alias("text")), key="id")
    # at most 1,024 lines an event
    ordered = pieces.select("id.doc_id", (F.col("id.event_id") * 1_024 + F.col("line_no")).alias("place"), "line", "chars")
    numbered = running_sum(written(ordered, "owner-lines"), ["doc_id"], "place", F.lit(1), "line_no", size=EVENT_RANGE * 1_024)
    return numbered.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line", "chars")


def log_corpus(spark: SparkSession, sf_dir: str, style: str = "mixed") -> DataFrame:
    return spark.sql(corpus_sql("spark", style, sf_dir))


# Pipe-delimited order lines of one customer and year.
ORDERS_SQL = """
select doc_id, concat('orders-', doc_id, '.txt') as name, {agg} as text
from (select o_custkey * 1000000 + year(o_orderdate) as doc_id,
        o_orderkey as event_id,
        concat(o_orderkey, '|', o_orderstatus, '|', cast(floor(o_totalprice) as bigint), '|',
               o_orderpriority, case when o_orderkey % 11 = 3 then '|extra' else '' end) as line
      from {table})
group by doc_id
"""


def order_corpus_sql(engine: str, sf_dir: str = "") -> str:
    agg = _dialect(engine)["agg"].format(sep="chr(10)")
    table = f"parquet.`{sf_dir}/orders.parquet`" if engine == "spark" else "orders"
    return ORDERS_SQL.format(agg=agg, table=table)


def order_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(order_corpus_sql("spark", sf_dir))


# Prose with secrets, tabs, CR and trailing blanks put in at sentence ends.
MARKED_TEXT = """replace(text, '. ', case doc_id % 7
  when 0 then concat('. password=s3cret tail', chr(10))
  when 1 then concat('. Authorization: Bearer abc.def', chr(13), chr(10), 'next ')
  when 2 then concat('. API_KEY=k', doc_id, ' and Token=t', doc_id, chr(9), chr(10))
  when 3 then concat('. 10.0.0.', doc_id % 250, ' a.b+c@mail.example.org josé@büro.example.org x٣.1.1.1  ', chr(13))
  when 4 then concat('. 123e4567-e89b-42d3-a456-426614174000', chr(9), 'x', chr(10))
  when 5 then '. apikey=a apikey=b token = "q" '
  else '. ' end)"""


def documents(spark: SparkSession, sf_dir: str, marked: bool = False) -> DataFrame:
    """The prose documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.withColumn("text", F.expr(MARKED_TEXT)) if marked else docs


def marked_sql() -> str:
    return f"select doc_id, {MARKED_TEXT} as text from documents"


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that has fewer files than the cluster has cores, dealt out: a small table is one row
    group, which no setting splits. Larger tables are read as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)
