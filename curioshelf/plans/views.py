"""The domain tables, as views over the driver's tables.

One SQL text per view, run by Spark here and by DuckDB in the oracle.  ``@table`` marks a source
table.  Odd cases (NULLs, statistics that are no numbers, duplicates, unknown ids, foreign owners)
are planted on purpose.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curioshelf.functions.colors import WUBRG
from curioshelf.session import scratch

NOW = "2024-01-31 00:00:00"

_LETTERS = "chr(CAST(65 + {k} % 26 AS INT)) || chr(CAST(65 + ({k} * 7) % 26 AS INT)) || chr(CAST(65 + ({k} * 11) % 26 AS INT))"

VIEWS = {
    "cards": """
 select p_partkey id, p_name name,
 CASE WHEN p_partkey % 7 = 0 THEN p_brand || ' ' || p_name END flavor_name,
 CASE WHEN p_partkey % 29 = 0 THEN 'Card' WHEN p_partkey % 31 = 0 THEN NULL
      ELSE p_type || ' ' || p_name END type_line,
 lower(p_brand) set_code,
 CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey % 500 AS STRING) || 'a'
      WHEN 1 THEN 'P' || CAST(p_partkey % 500 AS STRING)
      ELSE CAST(p_partkey % 500 AS STRING) END collector_number,
 CAST(p_size % 9 AS DOUBLE)
   + CASE WHEN p_partkey % 41 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END cmc,
 CASE p_size % 10 WHEN 0 THEN '*' WHEN 1 THEN NULL WHEN 2 THEN '1+*' WHEN 3 THEN '-1'
      ELSE CAST(p_size % 10 AS STRING) END power,
 CASE p_partkey % 10 WHEN 0 THEN '*' WHEN 1 THEN NULL WHEN 2 THEN '1+*'
      ELSE CAST(p_partkey % 10 AS STRING) END toughness,
 CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size % 7 AS STRING) WHEN p_partkey % 6 = 1 THEN 'X' END loyalty,
 CASE p_partkey % 5 WHEN 0 THEN 'common' WHEN 1 THEN 'uncommon' WHEN 2 THEN 'rare'
      WHEN 3 THEN 'mythic' ELSE 'special' END rarity,
 CASE p_size % 9 WHEN 0 THEN 'token' WHEN 1 THEN 'emblem' WHEN 2 THEN 'transform' ELSE 'normal' END layout,
 CASE WHEN p_partkey % 3 = 0 THEN 'ja' ELSE 'en' END lang,
 CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE p_partkey & 31 END color_mask,
 (p_partkey | p_size) & 31 identity_mask,
 '{' || CAST(p_size % 5 AS STRING) || '}' || CASE WHEN (p_partkey & 1) = 1 THEN '{W}' ELSE '' END
   || CASE WHEN (p_partkey & 2) = 2 THEN '{U}' ELSE '' END
   || CASE WHEN (p_partkey & 8) = 8 THEN '{R}{R}' ELSE '' END mana_cost,
 p_partkey % 43 = 0 variation, p_partkey % 47 = 0 digital, p_partkey % 53 = 0 oversized,
 p_retailprice usd
 from @part""",
    "imported": """
 select * from cards where not variation and not digital and not oversized
 and type_line is not null and type_line not in ('Card', 'Card // Card')""",
    "copies": """
 select CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
   || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-'
   || CAST(CAST(l_quantity AS INT) AS STRING) copy_id,
 c_nationkey owner, l_partkey card_id,
 CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN NULL ELSE o_custkey END collection_id,
 CASE WHEN l_linestatus = 'F' THEN l_suppkey - l_suppkey % 25 + c_nationkey END deck_id,
 CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'foil' END notes,
 CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'b,a' WHEN 2 THEN 'a,b' ELSE 'staple' END tags_csv,
 CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS INT) added_day,
 l_linenumber line_no, l_returnflag flag, CAST(l_quantity AS INT) qty, o_orderpriority priority,
 o_orderstatus status
 from @lineitem join @orders on l_orderkey = o_orderkey join @customer on o_custkey = c_custkey""",
    # Few cards, collections and decks for the number of copies, so that groups are large; there are
    # more of them as the catalogue grows.
    "dense": """
 select copy_id, CAST(collection_id % 10 AS INT) % 5 owner, card_id % (20 + CAST(floor(parts / 1000) AS BIGINT)) card_id,
 collection_id % 10 collection_id, deck_id % 5 deck_id, notes, tags_csv, qty
 from copies, (select CAST(count(*) AS BIGINT) parts from @part) p""",
    "collections": """
 select c_custkey id, c_name name, c_mktsegment description, c_nationkey owner,
 c_acctbal > 5000 is_active, max(o_orderdate) updated_at
 from @customer left join @orders on c_custkey = o_custkey
 group by c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal""",
    "decks": """
 select s_suppkey id, s_name name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'sideboard' END description,
 CAST(CASE WHEN s_suppkey % 19 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS INT) % 25 owner,
 s_acctbal > 5000 is_active
 from @supplier""",
    # Copies of line 7 are missing from the arrangement; every deck holds one unknown id.
    "placements": """
 select deck_id, flag section_id, 'c' || CAST(line_no % 3 AS STRING) column_id,
 CAST(added_day AS BIGINT) pos, copy_id
 from copies where deck_id is not null and line_no <> 7
 union all
 select s_suppkey, 'A', 'c0', CAST(0 AS BIGINT), 'missing-' || CAST(s_suppkey AS STRING) from @supplier""",
    # Every deck also has an empty section of one column (E) and one without columns (Z).
    "layout": """
 select distinct deck_id, section_id, 'Section ' || section_id section_name,
 CASE section_id WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END section_pos,
 column_id, CAST(substring(column_id, 2) AS INT) column_pos from placements
 union all
 select s_suppkey, 'E', 'Empty', 3, 'c0', 0 from @supplier
 union all
 select s_suppkey, 'Z', 'Bare', 4, CAST(NULL AS STRING), CAST(NULL AS INT) from @supplier""",
    "price_log": """
 select user_id card_id, CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(12,2)) END usd,
 ts updated_at from @events""",
    "price_cache": """
 select card_id, usd, CASE WHEN card_id % 17 = 3 THEN NULL ELSE updated_at END updated_at from
 (select *, row_number() over (partition by card_id order by updated_at desc) rn from price_log) t
 where rn = 1""",
    "fx_log": f"""
 select 'USD' base, {_LETTERS.format(k="(user_id % 26)")} target, CAST(value AS DOUBLE) / 10 rate,
 CASE WHEN user_id % 26 % 5 = 0 THEN ts - INTERVAL '3' DAY ELSE ts END updated_at from @events""",
    "fx_rates": """
 select base, target, rate, updated_at from
 (select *, row_number() over (partition by base, target order by updated_at desc) rn from fx_log) t
 where rn = 1""",
    "fx_requests": f"""
 select o_orderkey request_id, CAST(o_totalprice AS DECIMAL(12,2)) usd, CASE o_custkey % 7
   WHEN 0 THEN 'USD' WHEN 1 THEN 'XX' WHEN 2 THEN lower({_LETTERS.format(k="(o_custkey % 26)")})
   WHEN 3 THEN 'QQ' || CAST(o_custkey % 4 AS STRING) WHEN 4 THEN 'QQQ'
   ELSE {_LETTERS.format(k="(o_custkey % 26)")} END target from @orders""",
    # One in five candidates is unknown; the others range over the whole catalogue.
    "scan": """
 select conv_id detected, turn rank_no,
 (conv_id * 7919 + turn * 104729) % (select CAST(floor(count(*) * 1.25) AS BIGINT) from @part) card_id
 from @conversations""",
    "rules": """
 select doc_id id, lang, CASE doc_id % 6
  WHEN 0 THEN 'I, II — ' || text
  WHEN 1 THEN '+2: ' || text
  WHEN 2 THEN '−3: ' || text || chr(10) || '   ' || chr(10) || '0: ' || source
  WHEN 3 THEN 'X: ' || text || chr(10) || 'IV,XI - ' || source
  WHEN 4 THEN text || chr(10) || '5: ' || source || chr(10) || '-1: ' || source
  ELSE text || chr(10) || '{T}: add {G}{G} ({W/U} or {2}).' END oracle_text from @documents""",
    "saved_searches": """
 select s_suppkey search_id, CASE s_suppkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' END lang,
 CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 4 AS INT) END rarity_min,
 CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 5 END cmc_min,
 CASE WHEN s_suppkey % 6 <> 0 THEN 3 + s_suppkey % 6 END cmc_max,
 CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey & 31 END must_mask,
 CASE s_suppkey % 4 WHEN 1 THEN 'R' WHEN 2 THEN 'blue' WHEN 3 THEN 'BRAND#1' END name_part
 from @supplier""",
    # A bulk file: every card, then some of them again, with gaps and with records to reject.
    "bulk": """
 select CAST(id AS STRING) id, lang, layout, cmc, name,
 CASE WHEN id % 61 = 0 THEN 'Card // Card' WHEN id % 67 = 0 THEN '' ELSE type_line END type_line,
 CASE WHEN id % 71 = 0 THEN NULL ELSE 'black' END border_color, collector_number,
 CASE WHEN id % 73 = 0 THEN '' ELSE 'missing' END image_status, rarity, upper(set_code) set_name,
 set_code, mana_cost, power, variation, digital, oversized, 1 take from cards
 union all
 select CAST(id AS STRING), lang, layout, cmc + 1, name || ' (again)', type_line, 'white',
 collector_number, 'missing', rarity, upper(set_code), set_code, mana_cost, power,
 false, false, false, 2 from cards where cmc >= 5""",
}

# Views that a deployment would keep as tables.  They are written once per session and source
# folder, so that what a query costs is the query and not the making of its inputs.
STORED = ["copies", "placements", "layout", "collections", "price_cache", "fx_rates"]

# The same rows for Spark.  It keeps the order of joins: orders get their customer's nation before they
# meet the line items, which are then dealt out once.  The newest row of a key is found by hashing, as a
# rank sorts the whole log, once on each side of the shuffle; without any time every row is as new.
_NEWEST = """CASE WHEN max(updated_at) IS NULL THEN max({value}) ELSE max_by({value}, updated_at) END {value},
 max(updated_at) updated_at"""
SPARK_VIEWS = {
    **VIEWS,
    "copies": VIEWS["copies"].replace(
        "from @lineitem join @orders on l_orderkey = o_orderkey join @customer on o_custkey = c_custkey",
        """from @lineitem join (select o_orderkey, o_custkey, o_orderpriority, o_orderstatus, c_nationkey
   from @orders join @customer on o_custkey = c_custkey) o on l_orderkey = o_orderkey""",
    ),
    "price_cache": f"""
 select card_id, usd, CASE WHEN card_id % 17 = 3 THEN NULL ELSE updated_at END updated_at from
 (select card_id, {_NEWEST.format(value="usd")} from price_log group by card_id) t""",
    "fx_rates": f"""
 select base, target, {_NEWEST.format(value="rate")} from fx_log group by base, target""",
}


def views_in(sql: str, definitions: dict[str, str] = VIEWS, stop: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Names of the views a query uses, directly or not, each after those it depends on; what views in
    ``stop`` depend on is left out."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in definitions:
            if re.search(rf"(?i)\b(?:from|join)\s+{name}\b", text) and name not in needed:
                if name not in stop:
                    visit(definitions[name])
                needed.append(name)

    visit(sql)
    return needed


def with_views(sql: str, definitions: dict[str, str] = VIEWS) -> str:
    """Put the definitions of the views a query uses in front of it."""
    needed = views_in(sql, definitions)
    if not needed:
        return sql
    given = ",\n".join(f"{name} as ({definitions[name]})" for name in needed)
    joiner = ",\n" if sql.lstrip().lower().startswith("with ") else "\n"
    rest = sql.lstrip()[5:] if joiner == ",\n" else sql
    return f"with {given}{joiner}{rest}"


def for_duckdb(sql: str) -> str:
    return with_views(sql).replace("@", "")


def color_array(mask: str):
    """Colour letters of a bit mask, NULL for a NULL mask."""
    letters = [F.when(F.col(mask).bitwiseAND(1 << i) > 0, F.lit(c)) for i, c in enumerate(WUBRG)]
    return F.when(F.col(mask).isNotNull(), F.array_compact(F.array(*letters)))


class Views:
    """The views as DataFrames with the library's column names."""

    # Temporary views of the stored views, by session, source folder and name.
    _stored: dict[tuple[str, str, str], str] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _source(self, table: str) -> str:
        """Name of the temporary view of a source table, whose files are looked up only once."""
        name = f"curioshelf_{zlib.crc32(self.sf_dir.encode())}_{table}"
        if not self.spark.catalog.tableExists(name):
            source = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
            source.createOrReplaceTempView(name)
        return name

    def _run(self, text: str) -> DataFrame:
        return self.spark.sql(re.sub(r"@(\w+)", lambda m: self._source(m[1]), text))

    def _key(self, name: str) -> tuple[str, str, str]:
        return self.spark.sparkContext.applicationId, self.sf_dir, name

    def _keep(self, name: str, make: Callable[[], DataFrame]) -> str:
        """Temporary view of a table that is written when first asked for."""
        if self._key(name) not in self._stored:
            path = f"{scratch(self.spark)}/{name}"
            # Written as they are joined: dealing the rows out again only for even files costs a shuffle.
            make().write.option("compression", "zstd").parquet(path)
            view = f"{self._source('part')}_{name}"
            self.spark.read.parquet(path).createOrReplaceTempView(view)
            self._stored[self._key(name)] = view
        return self._stored[self._key(name)]

    def _make(self, name: str) -> DataFrame:
        return self._run(with_views(f"select * from {name}", self._definitions()))

    def _definitions(self) -> dict[str, str]:
        """View definitions, with those stored so far read from their files."""
        stored = {n: self._stored.get(self._key(n)) for n in VIEWS}
        return {n: f"select * from {stored[n]}" if stored[n] else text for n, text in SPARK_VIEWS.items()}

    def sql(self, text: str) -> DataFrame:
        # What a stored view is made of is not stored for its sake: a query that only reads the layout
        # of decks needs few columns of the copies.
        needed = views_in(text, VIEWS, STORED)
        for name in STORED:
            if name in needed:
                self._keep(name, lambda name=name: self._make(name))
        return self._run(with_views(text, self._definitions()))

    def once(self, text: str) -> DataFrame:
        """A query that reads few columns of stored views, and reads them once: what is stored already is
        read, the rest is joined for these columns alone and not written.  So narrow, many rows fit in a
        partition; orders are hashed there, as sorting that many line items would spill."""
        given = self._definitions()
        given["copies"] = given["copies"].replace("select", "select /*+ SHUFFLE_HASH(o) */", 1)
        return self._run(with_views(text, given))

    def view(self, name: str) -> DataFrame:
        return self.sql(f"select * from {name}")

    def tables(self, *names: str) -> list[DataFrame]:
        """The named views.  They are stored in the order in which they are made of each other, so that one
        that is asked for is read, and not made once more, by those after it."""
        for name in STORED:
            if name in names:
                self.view(name)
        return [getattr(self, name) for name in names]

    def _cards(self, name: str) -> DataFrame:
        """Catalogue records with arrays and the library's column names, kept as a table."""
        return self.spark.table(self._keep(f"{name}_table", lambda: self._card_records(name)))

    def _card_records(self, name: str) -> DataFrame:
        return (
            self.view(name)
            .withColumn("colors", color_array("color_mask"))
            .withColumn("color_identity", color_array("identity_mask"))
            .withColumn("keywords", F.split("name", " "))
            .withColumnRenamed("set_code", "set")
            .drop("color_mask", "identity_mask")
        )

    def _copies(self, name: str) -> DataFrame:
        return self.view(name).withColumn("tags", F.split("tags_csv", ",")).drop("tags_csv")

    @cached_property
    def cards(self) -> DataFrame:
        return self._cards("cards")

    @cached_property
    def imported(self) -> DataFrame:
        return self._cards("imported")

    @cached_property
    def copies(self) -> DataFrame:
        return self._copies("copies")

    @cached_property
    def dense(self) -> DataFrame:
        return self._copies("dense")

    @cached_property
    def searches(self) -> DataFrame:
        return (
            self.view("saved_searches")
            .withColumn("colors", color_array("must_mask"))
            .drop("must_mask")
        )

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        return self.view(name)
