"""Ordered decks and batch changes to copies, collections and decks."""

from __future__ import annotations

from pyspark.sql import functions as F

from curioshelf.operators import arrangement as A
from curioshelf.operators import joins
from curioshelf.operators import maintenance as M
from curioshelf.operators.ranking import grouped_rank
from curioshelf.operators.replay import deck_replay as deck_replay_of
from curioshelf.plans.join_queries import NOTES, TAGS
from curioshelf.plans.registry import query
from curioshelf.session import settled

COLUMN = "deck_id, section_id, column_id"
LAYOUT = "deck_id, section_id, section_name, section_pos, column_id, column_pos"
MAX_CARDS = 100

# -- reading ----------------------------------------------------------------------------------

_ALL_PLACES = f"""select l.*, p.pos, p.copy_id from layout l left join placements p
 on p.deck_id = l.deck_id and p.section_id = l.section_id and p.column_id = l.column_id"""


@query(
    "deck_explode",
    f"select deck_id, section_id, section_name, column_id, copy_id from ({_ALL_PLACES}) t",
)
def deck_explode(v):
    nested = A.deck_assemble(*v.tables("layout", "placements"), MAX_CARDS)
    flat = A.deck_explode(nested)
    return flat.select("deck_id", "section_id", "section_name", "column_id", "copy_id")


@query(
    "deck_assemble",
    f"""with ranked as (select *, CAST(floor((row_number() over (partition by deck_id order by section_pos,
      section_id, column_pos nulls first, column_id nulls first, coalesce(pos, 0), copy_id) - 1)
      / {MAX_CARDS}) AS BIGINT) part from ({_ALL_PLACES}) t)
    select deck_id, part, section_id, column_id,
    coalesce(string_agg(copy_id, ' ' order by pos, copy_id), '') cards from ranked
    group by deck_id, part, section_id, column_id""",
)
def deck_assemble(v):
    nested = A.deck_assemble(*v.tables("layout", "placements"), MAX_CARDS)
    sections = nested.select("deck_id", "part", F.explode("sections").alias("s"))
    columns = sections.select(
        "deck_id", "part", F.col("s.id").alias("section_id"), F.explode_outer("s.columns").alias("c")
    )
    return columns.select(
        "deck_id",
        "part",
        "section_id",
        F.col("c.id").alias("column_id"),
        F.coalesce(F.array_join("c.cards", " "), F.lit("")).alias("cards"),
    )


@query(
    "deck_detail",
    """select p.deck_id, section_id, column_id, pos, p.copy_id, i.name card_name, c.collection_id
    from placements p join decks d on d.id = p.deck_id
    join copies c on c.copy_id = p.copy_id and c.owner = d.owner join imported i on i.id = c.card_id""",
)
def deck_detail(v):
    detailed = joins.detail_copies(v.copies, v.imported)
    return A.deck_detail(v.placements, v.decks, detailed).select(
        "deck_id",
        "section_id",
        "column_id",
        "pos",
        "copy_id",
        F.col("card.name").alias("card_name"),
        "collection_id",
    )


_ORPHANS = """select c.deck_id, c.copy_id from copies c join decks d on d.id = c.deck_id and d.owner = c.owner
 left join placements p on p.deck_id = c.deck_id and p.copy_id = c.copy_id where p.copy_id is null"""


@query("deck_orphans", _ORPHANS)
def deck_orphans(v):
    return A.deck_orphans(*v.tables("placements", "copies"), v.decks)


@query(
    "deck_reconcile",
    f"""with first_column as (select {COLUMN} from (select *, row_number() over (partition by deck_id
      order by section_pos, section_id, column_id is null, column_pos, column_id) rn from layout) t
      where rn = 1),
    ends as (select {COLUMN}, max(pos) last from placements group by {COLUMN})
    select {COLUMN}, pos, copy_id from placements union all
    select f.deck_id, f.section_id, f.column_id, coalesce(e.last + 1, 0), o.copy_id from ({_ORPHANS}) o
    join first_column f on f.deck_id = o.deck_id left join ends e on e.deck_id = f.deck_id
    and e.section_id = f.section_id and e.column_id = f.column_id""",
)
def deck_reconcile(v):
    return A.deck_reconcile(*v.tables("placements", "layout", "copies"), v.decks)[0]


# -- placing and removing ---------------------------------------------------------------------

# Copies of quantity 7 go to decks of their owner: to the first section, to a named column, to the
# empty section, or to a section that does not exist; at the front, inside, beyond the end, or last,
# often next to each other.  For some of them a later request for a deck of someone else is void.
_PLACE = """select copy_id, (added_day % 4) * 25 + owner deck_id,
 CASE line_no % 4 WHEN 1 THEN 'A' WHEN 2 THEN 'E' WHEN 3 THEN 'nope' END section_id,
 CASE WHEN line_no % 2 = 1 THEN 'c1' END column_id,
 CASE priority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 100000
   WHEN '5-LOW' THEN added_day % 5 - 1 END as "index",
 added_day seq from copies where qty = 7
 union all select copy_id, (added_day % 4) * 25 + (owner + 1) % 25, NULL, NULL, 0, added_day + 1000000 from copies
 where qty = 7 and line_no < 4"""
_PLACED = f"""req as (select r.*, f.section_id first_section, f.column_id first_column, s.column_id own_column,
   s.section_id own_section, x.column_id exact_column
  from ({_PLACE}) r join copies c on c.copy_id = r.copy_id join decks d on d.id = r.deck_id and d.owner = c.owner
  left join (select * from (select *, row_number() over (partition by deck_id order by section_pos,
    section_id, column_id is null, column_pos, column_id) rn from layout) t where rn = 1) f
    on f.deck_id = r.deck_id
  left join (select * from (select *, row_number() over (partition by deck_id, section_id order by
    column_id is null, column_pos, column_id) rn from layout) t where rn = 1) s
    on s.deck_id = r.deck_id and s.section_id = r.section_id
  left join layout x on x.deck_id = r.deck_id and x.section_id = r.section_id and x.column_id = r.column_id
  qualify row_number() over (partition by r.copy_id order by r.seq desc) = 1),
 target as (select copy_id, seq, "index", deck_id,
   CASE WHEN section_id is null THEN coalesce(first_section, 'main')
     ELSE coalesce(own_section, 'made:' || section_id) END section_id,
   coalesce(CASE WHEN section_id is null THEN first_column WHEN column_id is null THEN own_column
     ELSE coalesce(exact_column, 'made:' || column_id) END, 'main') column_id from req)"""


def _placed(v):
    requests = v.sql(_PLACE.replace('"index"', "index"))
    return A.resolve_places(*v.tables("layout", "copies"), v.decks, requests)


@query(
    "deck_place",
    f"""with {_PLACED},
    base as (select * from placements where copy_id not in (select copy_id from target)),
    touched as (select distinct {COLUMN} from target),
    old as (select b.*, t.deck_id is not null hit from base b left join touched t on t.deck_id = b.deck_id
      and t.section_id = b.section_id and t.column_id = b.column_id),
    ranked as (select {COLUMN}, copy_id, 2 * row_number() over (partition by {COLUMN} order by pos, copy_id) - 1 k
      from old where hit),
    lens as (select {COLUMN}, count(*) n from ranked group by {COLUMN}),
    turns as (select *, CASE WHEN "index" < 0 THEN 0 ELSE "index" END spot, row_number() over w place from target
      window w as (partition by {COLUMN} order by seq, copy_id)),
    breaks as (select *, sum(CASE WHEN spot = lag_spot + 1 THEN 0 ELSE 1 END) over (partition by {COLUMN} order by place) run
      from (select *, lag(spot) over (partition by {COLUMN} order by place) lag_spot from turns) x),
    runs as (select *, first_value(spot) over r start, first_value(seq) over r first_seq from breaks
      window r as (partition by {COLUMN}, run order by place)),
    new as (select t.deck_id, t.section_id, t.column_id, copy_id, seq,
      2 * CASE WHEN start <= coalesce(n, 0) THEN start ELSE coalesce(n, 0) END k, CASE WHEN start <= coalesce(n, 0) THEN -first_seq ELSE 0 END turn
      from runs t left join lens l on l.deck_id = t.deck_id and l.section_id = t.section_id
      and l.column_id = t.column_id)
    select {COLUMN}, pos, copy_id from old where not hit union all
    select {COLUMN}, row_number() over (partition by {COLUMN} order by k, turn, seq, copy_id) - 1, copy_id
    from (select {COLUMN}, copy_id, k, 0 turn, 0 seq from ranked union all
          select {COLUMN}, copy_id, k, turn, seq from new) m""",
)
def deck_place(v):
    placements, _, _ = v.tables("placements", "layout", "copies")
    return A.place_rows(placements, settled(_placed(v)))


@query(
    "deck_place_columns",
    f"""with {_PLACED},
    made as (select distinct {COLUMN} from target t where not exists (select 1 from layout l
      where l.deck_id = t.deck_id and l.section_id = t.section_id and l.column_id = t.column_id)),
    sections as (select deck_id, section_id, min(section_name) section_name, min(section_pos) section_pos,
      max(column_pos) last from layout group by deck_id, section_id),
    ends as (select deck_id, max(section_pos) last from layout group by deck_id)
    select {LAYOUT} from layout union all
    select m.deck_id, m.section_id, coalesce(s.section_name, 'Main'), coalesce(s.section_pos, e.last + 1),
    m.column_id, coalesce(s.last + 1, 0) from made m
    left join sections s on s.deck_id = m.deck_id and s.section_id = m.section_id
    left join ends e on e.deck_id = m.deck_id""",
)
def deck_place_columns(v):
    return A.place_columns(v.layout, _placed(v))


@query(
    "deck_place_copies",
    f"""with {_PLACED} select c.copy_id, coalesce(t.deck_id, c.deck_id) deck_id, c.collection_id
    from copies c left join target t on t.copy_id = c.copy_id""",
)
def deck_place_copies(v):
    return A.place_copies(v.copies, _placed(v)).select("copy_id", "deck_id", "collection_id")


# The same requests one after another, and more for some of the copies: twice within one column, and
# on to another deck of the owner.
_REPLAY = f"""{_PLACE}
 union all select copy_id, (added_day % 4) * 25 + owner, NULL, NULL, line_no, added_day + 5000 from copies where qty = 7 and line_no < 4
 union all select copy_id, (added_day % 4) * 25 + owner, NULL, NULL, 1, added_day + 10000 from copies where qty = 7 and line_no = 2
 union all select copy_id, ((added_day + 1) % 4) * 25 + owner, 'A', 'c1', 2, added_day + 20000 from copies where qty = 7 and line_no = 3"""
_EVENTS = f"""with {_PLACED.replace(_PLACE, _REPLAY).replace("  qualify row_number() over (partition by r.copy_id order by r.seq desc) = 1", "")},
    turns as (select *, lag(deck_id) over w last_deck, lag(section_id) over w last_section, lag(column_id) over w last_column
      from target window w as (partition by copy_id order by seq)),
    firsts as (select copy_id, seq from turns where last_deck is null),
    events as (select {COLUMN}, seq, copy_id, 1 comes, coalesce("index"::varchar, '') spot from turns
      union all select last_deck, last_section, last_column, seq, copy_id, 0, '' from turns where last_deck is not null
      union all select {COLUMN}, f.seq, copy_id, 0, '' from placements join firsts f using (copy_id)),
    asked as (select {COLUMN}, list([copy_id, comes::varchar, spot] order by seq, copy_id, comes) steps from events group by {COLUMN}),
    held as (select {COLUMN}, list(copy_id order by pos, copy_id) cards from placements group by {COLUMN}),
    done as (select {COLUMN}, list_reduce([coalesce(cards, []::varchar[])] || steps, lambda a, e:
        CASE WHEN e[2] = '0' THEN list_filter(a, lambda x: x <> e[1])
          WHEN e[3] = '' THEN a || [e[1]]
          ELSE a[1:least(greatest(e[3]::bigint, 0), len(a))] || [e[1]] || a[least(greatest(e[3]::bigint, 0), len(a)) + 1:] END) cards
      from asked left join held using ({COLUMN}))"""


@query(
    "deck_replay",
    f"""{_EVENTS},
    every as (select * from done union all select * from held where not exists (select 1 from asked
      where asked.deck_id = held.deck_id and asked.section_id = held.section_id and asked.column_id = held.column_id))
    select {COLUMN}, unnest(range(1, len(cards) + 1)) place, unnest(cards) copy_id from every""",
)
def deck_replay(v):
    placed = deck_replay_of(*v.tables("placements", "layout", "copies"), v.decks, v.sql(_REPLAY.replace('"index"', "index")))[0]
    ranked = grouped_rank(placed, A.COLUMN, [("pos", "asc"), ("copy_id", "asc")], "place")
    return ranked.select(*A.COLUMN, "place", "copy_id")


_TAKE = """select copy_id, CASE WHEN line_no = 5 THEN owner + 1 ELSE owner END owner from copies where qty = 9"""
_TAKEN = f"select t.copy_id from ({_TAKE}) t join copies c on c.copy_id = t.copy_id and c.owner = t.owner"


def _pulled(taken: str) -> str:
    """Placements left after pulling (owner, copy) pairs from decks of that owner."""
    return f"""select {COLUMN}, pos, copy_id from placements p where not exists (select 1 from ({taken}) t
    join decks d on d.owner = t.owner where t.copy_id = p.copy_id and d.id = p.deck_id)"""


@query("deck_pull", _pulled(_TAKE))
def deck_pull(v):
    return A.deck_pull(v.placements, v.decks, v.sql(_TAKE))


_REAL = f"select t.* from ({_TAKE}) t join copies c on c.copy_id = t.copy_id and c.owner = t.owner"


@query("deck_remove", _pulled(_REAL))
def deck_remove(v):
    return A.deck_remove(*v.tables("placements", "copies"), v.decks, v.sql(_TAKE))[0]


@query(
    "deck_remove_copies",
    f"""select c.copy_id, c.collection_id, CASE WHEN t.copy_id is null THEN c.deck_id END deck_id
    from copies c left join ({_TAKEN}) t on t.copy_id = c.copy_id
    where t.copy_id is null or c.collection_id is not null""",
)
def deck_remove_copies(v):
    left = A.deck_remove(*v.tables("placements", "copies"), v.decks, v.sql(_TAKE))[1]
    return left.select("copy_id", "collection_id", "deck_id")


# -- sections and columns ---------------------------------------------------------------------

_ADD_SECTION = """select id deck_id, 'n1' section_id, CASE WHEN is_active THEN name END name, 1 seq from decks
 union all select id, 'n2', '', 2 from decks where is_active
 union all select c_custkey + 1000000, 'n1', 'lost', 1 from @customer"""


@query(
    "section_add",
    f"""select {LAYOUT} from layout union all
    select r.deck_id, r.section_id, coalesce(nullif(r.name, ''), 'New Section'), coalesce(e.last, -1) + r.seq,
    'main', 0 from ({_ADD_SECTION}) r join decks d on d.id = r.deck_id
    left join (select deck_id, max(section_pos) last from layout group by deck_id) e on e.deck_id = r.deck_id""",
)
def section_add(v):
    return A.section_add(v.layout, v.decks, v.sql(_ADD_SECTION))


_ADD_COLUMN = """select id deck_id, 'A' section_id, 'x1' column_id, 1 seq from decks
 union all select id, 'A', 'x2', 2 from decks
 union all select id, 'Z', 'x1', 1 from decks where is_active
 union all select id, 'nope', 'x1', 1 from decks"""


@query(
    "column_add",
    f"""with added as (select r.deck_id, r.section_id, s.section_name, s.section_pos, r.column_id,
      coalesce(s.last, -1) + r.seq column_pos from ({_ADD_COLUMN}) r join
      (select deck_id, section_id, min(section_name) section_name, min(section_pos) section_pos,
       max(column_pos) last from layout group by deck_id, section_id) s
      on s.deck_id = r.deck_id and s.section_id = r.section_id)
    select {LAYOUT} from added union all select {LAYOUT} from layout l where column_id is not null
    or not exists (select 1 from added a where a.deck_id = l.deck_id and a.section_id = l.section_id)""",
)
def column_add(v):
    return A.column_add(v.layout, v.sql(_ADD_COLUMN))


_RENAME = "select id deck_id, CASE WHEN is_active THEN 'A' ELSE 'Z' END section_id, name from decks"


@query(
    "section_rename",
    f"""select l.deck_id, l.section_id, coalesce(r.name, l.section_name) section_name, section_pos,
    column_id, column_pos from layout l left join ({_RENAME}) r
    on r.deck_id = l.deck_id and r.section_id = l.section_id""",
)
def section_rename(v):
    return A.section_rename(v.layout, v.sql(_RENAME))


_SECTION_ORDER = """select id deck_id, 'R' section_id, 0 place from decks where is_active
 union all select id, 'A', 1 from decks where is_active"""


@query(
    "section_reorder",
    f"""with s as (select distinct deck_id, section_id, section_pos from layout
      where deck_id in (select deck_id from ({_SECTION_ORDER}) o)),
    ranked as (select s.deck_id, s.section_id, CAST(row_number() over (partition by s.deck_id order by
      coalesce(place, -1), section_pos, s.section_id) - 1 AS INT) fresh from s left join ({_SECTION_ORDER}) o
      on o.deck_id = s.deck_id and o.section_id = s.section_id)
    select l.deck_id, l.section_id, section_name, coalesce(fresh, section_pos) section_pos, column_id,
    column_pos from layout l left join ranked r on r.deck_id = l.deck_id and r.section_id = l.section_id""",
)
def section_reorder(v):
    return A.section_reorder(v.layout, v.sql(_SECTION_ORDER))


_COLUMN_ORDER = """select id deck_id, 'A' section_id, 'c2' column_id, 0 place from decks
 union all select id, 'A', 'c0', 1 from decks union all select id, 'N', 'c1', 0 from decks where is_active"""


@query(
    "column_reorder",
    f"""with c as (select * from layout l where column_id is not null and exists (select 1
      from ({_COLUMN_ORDER}) o where o.deck_id = l.deck_id and o.section_id = l.section_id)),
    ranked as (select c.deck_id, c.section_id, c.column_id, CAST(row_number() over
      (partition by c.deck_id, c.section_id order by coalesce(place, -1), column_pos, c.column_id) - 1 AS INT) fresh
      from c left join ({_COLUMN_ORDER}) o
      on o.deck_id = c.deck_id and o.section_id = c.section_id and o.column_id = c.column_id)
    select l.deck_id, l.section_id, section_name, section_pos, l.column_id, coalesce(fresh, column_pos) column_pos
    from layout l left join ranked r
    on r.deck_id = l.deck_id and r.section_id = l.section_id and r.column_id = l.column_id""",
)
def column_reorder(v):
    return A.column_reorder(v.layout, v.sql(_COLUMN_ORDER))


_DROP_SECTION = """select id deck_id, 'E' section_id from decks union all select id, 'A' from decks
 union all select id, 'Q' from decks union all select id, 'Z' from decks where is_active"""
_SECTION_STATUS = f"""select r.deck_id, r.section_id, CASE WHEN l.deck_id is null THEN 'not_found'
 WHEN p.deck_id is not null THEN 'not_empty' ELSE 'deleted' END status from ({_DROP_SECTION}) r
 left join (select distinct deck_id, section_id from layout) l
   on l.deck_id = r.deck_id and l.section_id = r.section_id
 left join (select distinct deck_id, section_id from placements) p
   on p.deck_id = r.deck_id and p.section_id = r.section_id"""


@query("section_delete_report", _SECTION_STATUS)
def section_delete_report(v):
    return A.section_delete_empty(*v.tables("layout", "placements"), v.sql(_DROP_SECTION))[1]


@query(
    "section_delete_empty",
    f"""select {LAYOUT} from layout l where not exists (select 1 from ({_SECTION_STATUS}) s
    where s.status = 'deleted' and s.deck_id = l.deck_id and s.section_id = l.section_id)""",
)
def section_delete_empty(v):
    return A.section_delete_empty(*v.tables("layout", "placements"), v.sql(_DROP_SECTION))[0]


_DROP_COLUMN = """select id deck_id, 'E' section_id, 'c0' column_id from decks
 union all select id, 'A', 'c1' from decks union all select id, 'Q', 'c0' from decks"""
_COLUMN_STATUS = f"""select r.deck_id, r.section_id, r.column_id, CASE WHEN l.deck_id is null THEN 'not_found'
 WHEN p.deck_id is not null THEN 'not_empty' ELSE 'deleted' END status from ({_DROP_COLUMN}) r
 left join layout l on l.deck_id = r.deck_id and l.section_id = r.section_id and l.column_id = r.column_id
 left join (select distinct {COLUMN} from placements) p
   on p.deck_id = r.deck_id and p.section_id = r.section_id and p.column_id = r.column_id"""


@query("column_delete_report", _COLUMN_STATUS)
def column_delete_report(v):
    return A.column_delete_empty(*v.tables("layout", "placements"), v.sql(_DROP_COLUMN))[1]


@query(
    "column_delete_empty",
    f"""with remaining as (select {LAYOUT} from layout l where not exists (select 1 from ({_COLUMN_STATUS}) s
      where s.status = 'deleted' and s.deck_id = l.deck_id and s.section_id = l.section_id
      and s.column_id = l.column_id))
    select {LAYOUT} from remaining union all
    select distinct deck_id, section_id, section_name, section_pos, CAST(NULL AS STRING), CAST(NULL AS INT)
    from layout l where not exists (select 1 from remaining k
    where k.deck_id = l.deck_id and k.section_id = l.section_id)""",
)
def column_delete_empty(v):
    return A.column_delete_empty(*v.tables("layout", "placements"), v.sql(_DROP_COLUMN))[0]


# -- copies -----------------------------------------------------------------------------------

_CREATE = """select CAST(o_orderkey AS STRING) request_id, c_nationkey owner,
 CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END card_id,
 CASE o_orderstatus WHEN 'O' THEN o_custkey WHEN 'P' THEN o_custkey + 1 END collection_id,
 CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 4 * 25 + c_nationkey AS BIGINT) END deck_id, 'new' notes,
 CASE o_orderkey % 5 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(2.7 AS DOUBLE)
   WHEN 2 THEN CAST(3 AS DOUBLE) WHEN 3 THEN CAST(-4 AS DOUBLE) END quantity
 from @orders join @customer on o_custkey = c_custkey"""
_CHECKED = f"""select r.*, CAST(greatest(floor(coalesce(quantity, 1)), 1) AS BIGINT) n,
 CASE WHEN card_id is null THEN 'no_card' WHEN collection_id is null and deck_id is null THEN 'no_deck'
 WHEN collection_id is not null and k.id is null THEN 'collection_not_found'
 WHEN deck_id is not null and d.id is null THEN 'deck_not_found' ELSE 'ok' END status from ({_CREATE}) r
 left join collections k on k.id = r.collection_id and k.owner = r.owner
 left join decks d on d.id = r.deck_id and d.owner = r.owner"""


def _creations(v):
    return v.sql(_CREATE).withColumn("tags", F.lit(None).cast("array<string>"))


@query(
    "copies_create",
    f"""select request_id || '-' || CAST(i AS STRING) copy_id, owner, card_id, collection_id, deck_id from
    (select *, unnest(range(1, n + 1)) i from ({_CHECKED}) c where status = 'ok') t""",
)
def copies_create(v):
    made = M.copies_create(_creations(v), v.collections, v.decks)
    return made.select("copy_id", "owner", "card_id", "collection_id", "deck_id")


def _placed_creations(v):
    requests = _creations(v).select(
        "*",
        F.lit(None).cast("string").alias("section_id"),
        F.lit(None).cast("string").alias("column_id"),
        F.lit(None).cast("int").alias("index"),
        F.col("request_id").cast("bigint").alias("seq"),
    )
    return M.copies_create_placed(requests, v.collections, v.decks, *v.tables("layout", "placements"))


@query(
    "copies_create_placements",
    f"""with made as (select request_id || '-' || CAST(i AS STRING) copy_id, deck_id, CAST(request_id AS BIGINT) seq, i
      from (select *, unnest(range(1, n + 1)) i from ({_CHECKED}) c where status = 'ok' and deck_id is not null) t),
    first_column as (select {COLUMN} from (select *, row_number() over (partition by deck_id
      order by section_pos, section_id, column_id is null, column_pos, column_id) rn from layout) t where rn = 1),
    fresh as (select f.deck_id, f.section_id, f.column_id, copy_id, seq, i from made m join first_column f on f.deck_id = m.deck_id),
    touched as (select distinct {COLUMN} from fresh),
    old as (select p.*, t.deck_id is not null hit from placements p left join touched t on t.deck_id = p.deck_id
      and t.section_id = p.section_id and t.column_id = p.column_id)
    select {COLUMN}, pos, copy_id from old where not hit union all
    select {COLUMN}, row_number() over (partition by {COLUMN} order by fresh, a, b, copy_id) - 1, copy_id
    from (select {COLUMN}, copy_id, 0 fresh, pos a, 0 b from old where hit union all
          select {COLUMN}, copy_id, 1, seq, i from fresh) m""",
)
def copies_create_placements(v):
    return _placed_creations(v)[1]


@query("copies_create_report", f"select status, count(*) n from ({_CHECKED}) t group by status")
def copies_create_report(v):
    checked = M.checked_requests(_creations(v), v.collections, v.decks)
    return checked.groupBy("status").agg(F.count("*").alias("n"))


# Many copies have a second change that gives other fields than the first.
_CHANGE = """select CASE WHEN flag = 'A' THEN owner ELSE (owner + line_no) % 25 END owner, copy_id,
 CASE WHEN line_no < 3 THEN '' WHEN line_no < 5 THEN 'checked' END notes,
 CASE WHEN qty < 20 THEN 'b,c' END tags_csv,
 CASE WHEN line_no % 2 = 0 THEN collection_id + CAST(added_day % 3 AS INT) END collection_id, added_day seq
 from copies where status <> 'P'
 union all select owner, copy_id, CASE WHEN line_no % 2 = 1 THEN 'later' END, CASE WHEN line_no % 2 = 0 THEN 'z' END,
 NULL, added_day + 1000000 from copies where qty % 3 = 0"""


@query(
    "copies_update",
    f"""select c.copy_id, c.owner, coalesce(r.notes, c.notes) notes, coalesce(r.tags_csv, c.tags_csv) tags,
    coalesce(r.collection_id, c.collection_id) collection_id, c.deck_id from copies c left join
    (select h.owner, copy_id, max_by(notes, seq) filter (notes is not null) notes,
     max_by(tags_csv, seq) filter (tags_csv is not null) tags_csv,
     max_by(collection_id, seq) filter (collection_id is not null) collection_id
     from ({_CHANGE}) h left join collections k on k.id = h.collection_id and k.owner = h.owner
     where h.collection_id is null or k.id is not null group by h.owner, copy_id) r on r.copy_id = c.copy_id and r.owner = c.owner""",
)
def copies_update(v):
    changes = v.sql(_CHANGE).withColumn("tags", F.split("tags_csv", ",")).drop("tags_csv")
    updated = M.copies_update(v.copies, changes, v.collections)
    return updated.select(
        "copy_id", "owner", "notes", F.array_join("tags", ",").alias("tags"), "collection_id", "deck_id"
    )


@query("copies_delete", _pulled(_TAKE))
def copies_delete(v):
    return M.copies_delete(*v.tables("copies", "placements"), v.decks, v.sql(_TAKE))[1]


@query(
    "copies_delete_left",
    f"select copy_id from copies where copy_id not in ({_TAKEN})",
)
def copies_delete_left(v):
    return M.copies_delete(*v.tables("copies", "placements"), v.decks, v.sql(_TAKE))[0].select("copy_id")


# One request per display row of every card with quantity-30 copies, some of them void.
_REMOVE = """select distinct owner, collection_id, card_id, deck_id, notes,
 CASE WHEN tags_csv = 'a,b' THEN 'b,a' ELSE tags_csv END tags_csv,
 CASE WHEN card_id % 4 = 0 THEN 0 ELSE 1 + card_id % 7 END quantity from dense where qty = 30"""


_REMOVED = f"""wanted as (select owner, collection_id, card_id, deck_id, {NOTES} notes, {TAGS} tags,
      sum(quantity) quantity from ({_REMOVE}) r where quantity >= 1 and collection_id is not null group by all),
    numbered as (select *, row_number() over (partition by owner, collection_id, card_id, deck_id, {NOTES}, {TAGS}
      order by copy_id) rn from dense),
    removed as (select copy_id, owner from numbered n where exists (select 1 from wanted w where w.owner = n.owner
    and w.collection_id = n.collection_id and w.card_id = n.card_id
    and w.deck_id is not distinct from n.deck_id and w.notes = {NOTES.replace('notes', 'n.notes')}
    and w.tags = {TAGS.replace('tags_csv', 'n.tags_csv')} and n.rn <= w.quantity))"""


def _without_groups(v):
    requests = v.sql(_REMOVE).withColumn("tags", F.split("tags_csv", ","))
    return M.remove_group(v.dense, v.placements, v.decks, requests)


@query("remove_group", f"with {_REMOVED} select copy_id from dense where copy_id not in (select copy_id from removed)")
def remove_group(v):
    return _without_groups(v)[0].select("copy_id")


@query("remove_group_placements", f"with {_REMOVED} {_pulled('select copy_id, owner from removed')}")
def remove_group_placements(v):
    return _without_groups(v)[1]


_MOVES = """select CASE WHEN qty = 1 THEN (owner + 1) % 25 ELSE owner END owner, copy_id, line_no % 2 = 0 from_deck,
 CASE WHEN line_no < 4 THEN collection_id + CAST(line_no - 1 AS INT) * 3 END to_collection,
 CASE WHEN line_no >= 4 THEN (CASE WHEN line_no = 4 THEN deck_id
   ELSE CAST(line_no % 4 * 25 + owner AS BIGINT) END) END to_deck from copies"""


@query(
    "bulk_move",
    f"""with judged as (select m.*, c.collection_id, c.deck_id, CASE WHEN c.copy_id is null THEN 'copy_not_found'
      WHEN c.collection_id is null and m.to_deck is distinct from c.deck_id THEN 'rejected_ephemeral'
      WHEN to_deck is not null and d.id is null THEN 'deck_not_found' WHEN to_deck is not null THEN 'placed'
      WHEN k.id is null THEN 'collection_not_found'
      WHEN from_deck and c.deck_id is not null THEN 'taken_out'
      WHEN to_collection is not distinct from c.collection_id THEN 'unchanged' ELSE 'moved' END action
      from ({_MOVES}) m left join copies c on c.copy_id = m.copy_id and c.owner = m.owner
      left join collections k on k.id = to_collection and k.owner = m.owner
      left join decks d on d.id = to_deck and d.owner = m.owner)
    select copy_id, action,
    CASE WHEN action in ('taken_out', 'moved') THEN to_collection ELSE collection_id END collection_id,
    CASE WHEN action = 'placed' THEN to_deck WHEN action <> 'taken_out' THEN deck_id END deck_id from judged""",
)
def bulk_move(v):
    return M.bulk_move(v.copies, v.collections, v.decks, v.sql(_MOVES))


# -- collections and decks --------------------------------------------------------------------

_DROP_COLLECTION = """select id, CASE WHEN is_active THEN owner + 1 ELSE owner END owner from collections
 where description = 'FURNITURE'"""
_GONE = f"""select k.id from collections k join ({_DROP_COLLECTION}) r on r.id = k.id and r.owner = k.owner"""


def _without_collections(v):
    ids = v.sql(_DROP_COLLECTION)
    return M.delete_collection(v.collections, *v.tables("copies", "placements"), v.decks, ids)


@query("delete_collection", f"select id, owner from collections where id not in ({_GONE})")
def delete_collection(v):
    return _without_collections(v)[0].select("id", "owner")


@query(
    "delete_collection_copies",
    f"select copy_id from copies where collection_id is null or collection_id not in ({_GONE})",
)
def delete_collection_copies(v):
    return _without_collections(v)[1].select("copy_id")


@query(
    "delete_collection_placements",
    _pulled(f"select copy_id, owner from copies where collection_id in ({_GONE})"),
)
def delete_collection_placements(v):
    return _without_collections(v)[2]


_DROP_DECK = "select id, CASE WHEN description = '' THEN owner + 1 ELSE owner END owner from decks where is_active"
_GONE_DECK = f"select d.id, d.owner from decks d join ({_DROP_DECK}) r on r.id = d.id and r.owner = d.owner"


def _without_decks(v):
    return M.delete_deck(v.decks, *v.tables("copies", "layout", "placements"), v.sql(_DROP_DECK))


@query("delete_deck", f"select id, owner from decks where id not in (select id from ({_GONE_DECK}) g)")
def delete_deck(v):
    return _without_decks(v)[0].select("id", "owner")


@query(
    "delete_deck_copies",
    f"""select copy_id, collection_id, CASE WHEN g.id is null THEN deck_id END deck_id from copies c
    left join ({_GONE_DECK}) g on g.id = c.deck_id and g.owner = c.owner
    where g.id is null or collection_id is not null""",
)
def delete_deck_copies(v):
    return _without_decks(v)[1].select("copy_id", "collection_id", "deck_id")


@query("delete_deck_columns", f"select {LAYOUT} from layout where deck_id not in (select id from ({_GONE_DECK}) g)")
def delete_deck_columns(v):
    return _without_decks(v)[2]


@query(
    "delete_deck_placements",
    f"select {COLUMN}, pos, copy_id from placements where deck_id not in (select id from ({_GONE_DECK}) g)",
)
def delete_deck_placements(v):
    return _without_decks(v)[3]


_SWITCH = """select CAST(c_nationkey AS INT) owner, CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey + 1 ELSE o_custkey END id,
 o_totalprice > 400000 is_active, o_orderkey seq from @orders join @customer on o_custkey = c_custkey
 where c_nationkey <> 4"""


@query(
    "set_active",
    f"""with r as (select s.* from ({_SWITCH}) s join collections k on k.id = s.id and k.owner = s.owner),
    switched_on as (select owner, max(seq) on_seq, max_by(id, seq) on_id from r where is_active group by owner),
    switched_off as (select owner, id, max(seq) off_seq from r where not is_active group by owner, id)
    select k.id, k.owner, CASE WHEN on_seq is not null THEN k.id = on_id and coalesce(off_seq < on_seq, true)
    WHEN off_seq is not null THEN false ELSE is_active END is_active from collections k
    left join switched_on n on n.owner = k.owner left join switched_off f on f.owner = k.owner and f.id = k.id""",
)
def set_active(v):
    return M.set_active(v.collections, v.sql(_SWITCH)).select("id", "owner", "is_active")


_NEW = """select c_nationkey owner, c_custkey + 1000000 id, CASE c_mktsegment WHEN 'MACHINERY' THEN NULL
 WHEN 'FURNITURE' THEN '' ELSE c_name END name, CASE WHEN c_acctbal < 0 THEN c_mktsegment END description
 from @customer"""


@query(
    "collections_create",
    f"""select owner, id, name, coalesce(description, '') description, false is_active from ({_NEW}) n
    where name <> ''""",
)
def collections_create(v):
    return M.collections_create(v.sql(_NEW))


@query(
    "decks_create",
    f"""select owner, id, name, coalesce(description, '') description, 'Main' section_name, 0 section_pos,
    0 column_pos from ({_NEW}) n where name <> ''""",
)
def decks_create(v):
    decks, layout = M.decks_create(v.sql(_NEW))
    both = decks.join(layout, decks["id"] == layout["deck_id"])
    return both.select("owner", "id", "name", "description", "section_name", "section_pos", "column_pos")


_PATCH = """select c_nationkey owner, o_custkey id,
 CASE WHEN o_orderstatus = 'O' THEN 'Box ' || CAST(o_orderkey AS STRING) END name,
 CASE WHEN o_orderpriority < '3' THEN o_orderpriority END description, o_orderkey seq
 from @orders join @customer on o_custkey = c_custkey where o_orderstatus <> 'P'"""


@query(
    "entity_update",
    f"""with p as (select owner, id, max_by(name, seq) filter (where name is not null) name,
      max_by(description, seq) filter (where description is not null) description from ({_PATCH}) t
      group by owner, id)
    select k.id, k.owner, coalesce(p.name, k.name) name, coalesce(p.description, k.description) description
    from collections k left join p on p.owner = k.owner and p.id = k.id""",
)
def entity_update(v):
    updated = M.entity_update(v.collections, v.sql(_PATCH))
    return updated.select("id", "owner", "name", "description")
