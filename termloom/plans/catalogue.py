"""Queries of the terminology operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.operators import annotate, lexicon, linking, lookup, packed, tables
from termloom.session import cut, freed, maybe_broadcast, table
from termloom.sources import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _fold(w: str) -> str:
    for a, b in X.SPELLINGS:
        w = f"regexp_replace({w}, '{a}', '{b}'{'' if a.startswith('^') else ', ' + chr(39) + 'g' + chr(39)})"
    return w


_FILL = "[" + ", ".join(f"'{w}'" for w in X.FILLER_WORDS) + "]"
_CTX = "[" + ", ".join(f"'{w}'" for w in X.CONTEXT_WORDS) + "]"


def _plural(w: str) -> str:
    return f"case when length({w}) > 4 and {w}[-1] = 's' and not regexp_matches({w}, '(ss|us|is)$') then {w}[:-2] else {w} end"


def _clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '(?i)\\b(without|except|excluding|other than)\\b[^,;]*', ' ', 'g')"


def _folded(x: str) -> str:
    return f"list_transform(list_transform(list_filter(string_split({_norm(_clean(x))}, ' '), lambda w: w <> ''), lambda w: {_fold('w')}), lambda w: {_plural('w')})"


def _key(x: str) -> str:
    """The word set as a sorted list; null if too vague. Expects no null."""
    base = f"list_sort(list_distinct(list_filter({_folded(x)}, lambda w: not list_contains({_FILL}, w))))"
    return f"(select case when len(k) = 0 or (len(k) = 1 and length(k[1]) < 4) then null else k end from (select {base} k))"


_HOPS = "('umls_cui_of', 'may_be', 'maps_to', 'maps_to_approx', 'mapped_from', 'approx_mapped_from')"
_CONF = "coalesce(confidence, case when relationship_id in ('maps_to', 'mapped_from') then 0.8 when relationship_id in ('maps_to_approx', 'approx_mapped_from') then 0.7 else 1.0 end)"


def _t(s: SparkSession, d: str, n: str) -> DataFrame:
    return table(s, d, n)


# -- scalar functions --------------------------------------------------------------------


@query(f"select synonym_id, {_norm('term')} norm from concept_synonym where term is not null")
def q_normalize_terms(s, d):
    return _t(s, d, "concept_synonym").filter("term is not null").select("synonym_id", X.normalize(F.col("term")).alias("norm"))


@query()  # strip_accents does not fold ligatures and full-width letters
def q_normalize_documents(s, d):
    n = X.normalize(F.col("text"))
    return _t(s, d, "documents").filter("text is not null").select("doc_id", F.length(n).alias("n_chars_folded"), F.md5(n).alias("fold_hash"))


@query(f"select concept_id, array_to_string({_key('name')}, ' ') as word_key, len(list_intersect({_folded('name')}, ['nos', 'unspecified', 'unspec'])) > 0 as unspecified from concept where name is not null")
def q_word_key(s, d):
    ws = X.word_set(F.col("name"))
    return _t(s, d, "concept").filter("name is not null").select("concept_id", F.array_join(ws["key"], " ").alias("word_key"), ws["unspecified"].alias("unspecified"))


_BARE = "replace(code, '.', '')"
_AT = f"case when vocabulary_id = 'ICD9CM' and {_BARE}[1] = 'E' then 4 else 3 end"


@query(f"""select concept_id, case when length({_BARE}) <= {_AT} then {_BARE} else {_BARE}[:{_AT}] || '.' || {_BARE}[{_AT} + 1:] end dotted,
    case when vocabulary_id = 'ICD9CM' then case when upper(code[1]) in ('V', 'E') then 'observation' else 'condition' end when upper(code[1]) = 'R' then 'symptom' when upper(code[1]) between 'V' and 'Z' then 'observation' else 'condition' end domain_of_code,
    case when length({_BARE}) = 3 then 'category' when is_billable then 'code' else 'subcategory' end class_of_code,
    case when length({_BARE}) <= 2 then {_BARE} else {_BARE}[:2] || '.' || {_BARE}[3:] end dotted_procedure from concept where vocabulary_id in ('ICD10CM', 'ICD9CM')""")
def q_dotted_codes(s, d):
    c = _t(s, d, "concept").filter(F.col("vocabulary_id").isin("ICD10CM", "ICD9CM"))
    return c.select("concept_id", X.dotted(F.col("code"), F.col("vocabulary_id")).alias("dotted"), F.when(F.col("vocabulary_id") == "ICD9CM", X.icd9_domain(F.col("code"))).otherwise(X.code_domain(F.col("code"))).alias("domain_of_code"),
                    X.code_class(F.col("code"), F.col("is_billable")).alias("class_of_code"), X.dotted_procedure(F.col("code")).alias("dotted_procedure"))


@query(f"""with n as (select synonym_id, {_norm('term')} norm from concept_synonym where term is not null), l as (select *, regexp_extract(norm, '(\\S+)$', 1) w from n)
    select synonym_id, case when length(w) > 4 and w like '%ies' then regexp_replace(norm, 'ies$', 'y') when length(w) > 3 and w like '%s' and not regexp_matches(w, '(ss|us|is)$') then norm[:-2] else norm end singular from l""")
def q_singular_terms(s, d):
    return _t(s, d, "concept_synonym").filter("term is not null").select("synonym_id", X.singular(X.normalize(F.col("term"))).alias("singular"))


@query("""with t as (select fee_row_id, trim(units) t from ns_msi_sample where units is not null), n as (select *, regexp_extract(t, '^\\$?\\s*([\\d,]+(?:\\.\\d+)?)', 1) num from t)
    select fee_row_id, case when num <> '' and not contains(t, '%') then try_cast(replace(num, ',', '') as decimal(12,4)) end number,
    nullif(trim(case when num <> '' and not contains(t, '%') then regexp_replace(t, '^\\$?\\s*[\\d,]+(?:\\.\\d+)?\\s*', '') else t end), '') note from n""")
def q_printed_fees(s, d):
    p = X.printed_fee(F.col("units"), F.lit("units"))
    return _t(s, d, "ns_msi_sample").filter("units is not null").select("fee_row_id", p["number"].alias("number"), p["note"].alias("note"))


@query("select o_orderkey, o_orderdate::date as order_day from orders where o_orderdate is not null")
def q_printed_dates(s, d):
    o = _t(s, d, "orders").filter("o_orderdate is not null")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d MMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", X.printed_date(text).alias("order_day"))


# -- lookups -----------------------------------------------------------------------------


def _queries(s, d):
    return _t(s, d, "senses").filter("target is not null").select(F.col("target").alias("query")).distinct()


_Q = f"q as (select distinct target as query, {_norm('target')} norm from senses where target is not null and {_norm('target')} <> '')"
_M = f"m as (select q.query, s.concept_id, s.term, s.n = q.norm as exact from q join (select distinct concept_id, term, {_norm('term')} n from concept_synonym where term is not null) s on s.n = q.norm or starts_with(s.n, q.norm || ' '))"


@query(f"""with {_Q}, {_M}, b as (select query, concept_id, min((not exact)::int::varchar || term) k from m group by all)
    select * from (select query, row_number() over (partition by query order by k, concept_id)::int as "rank", concept_id, vocabulary_id, code, name, k[2:] term, k[1] = '0' as exact from b join concept using (concept_id)) where "rank" <= 20""")
def q_find_terms(s, d):
    return lookup.find_terms(_queries(s, d), _t(s, d, "concept_synonym"), _t(s, d, "concept"))


@query(f"""with {_Q}, {_M},
    h as (select m.query, m.exact, m.term, c.name source_name, t.code, t.name, t.is_billable, {_CONF} c from m join concept c using (concept_id) join concept_relationship r on r.concept_id_1 = m.concept_id and relationship_id in {_HOPS} join concept t on t.concept_id = r.concept_id_2 and t.vocabulary_id = 'ICD10CM'
        union all select m.query, m.exact, m.term, c.name, c.code, c.name, c.is_billable, 1.0 from m join concept c on c.concept_id = m.concept_id and c.vocabulary_id = 'ICD10CM'),
    k as (select query, code, name, not exact far, not coalesce({_key('source_name')} = {_key('term')}, false) aside, c * case when regexp_matches(name, '(?i)\\bin (diseases|conditions) classified elsewhere\\b') then 0.5 else 1.0 end c, not coalesce(is_billable, false) nobill, not contains(lower(name), 'unspecified') special from h),
    b as (select * from k qualify row_number() over (partition by query, code, name order by far, aside, -c, nobill, special) = 1)
    select * from (select query, row_number() over (partition by query order by far, aside, -c, nobill, special, code)::int as "rank", code, name, round(c, 6) confidence from b) where "rank" <= 20""")
def q_find_codes(s, d):
    return lookup.find_codes(_queries(s, d), _t(s, d, "concept_synonym"), _t(s, d, "concept"), _t(s, d, "concept_relationship"), "ICD10CM")


@query(f"""with c as (select concept_id, concept_id code_id, case when regexp_matches(name, '(?i)\\bin (diseases|conditions) classified elsewhere\\b') then 0.5 else 1.0 end conf, true own from concept where vocabulary_id in ('ICD10CM', 'ICD9CM', 'NS_MSI')
        union all select concept_id_1, concept_id_2, {_CONF}, false from concept_relationship where relationship_id in {_HOPS}),
    b as (select c.concept_id, t.vocabulary_id, t.code, t.name, coalesce(t.is_billable, false) billable, round(max(conf), 3) confidence from c join concept t on t.concept_id = c.code_id and t.vocabulary_id in ('ICD10CM', 'ICD9CM', 'NS_MSI') and (own or coalesce(t.concept_class, '') not in ('chapter', 'block')) group by all)
    select concept_id, vocabulary_id, code, name, confidence, r "rank" from (select *, row_number() over (partition by concept_id, vocabulary_id order by round(confidence - case when billable then 0 else 0.1 end, 6) desc, not contains(lower(name), 'unspecified'), code)::int r from b where confidence >= 0.4) where r <= 3""")
def q_concept_codes(s, d):
    return lookup.concept_codes(_t(s, d, "concept"), _t(s, d, "concept_relationship"), ["ICD10CM", "ICD9CM", "NS_MSI"])


@query("""select l.name lay_name, t.code, t.name, min(r.map_priority) map_priority, max(r.confidence) confidence from concept l join concept_relationship r on r.concept_id_1 = l.concept_id and r.relationship_id = 'may_be'
    join concept t on t.concept_id = r.concept_id_2 where l.vocabulary_id = 'LAY' or l.concept_id in (select concept_id from concept_synonym where term_type = 'lay') group by all""")
def q_lay_candidates(s, d):
    c, syn = _t(s, d, "concept"), _t(s, d, "concept_synonym").filter("term_type = 'lay'").select("concept_id").distinct().withColumn("lay", F.lit(True))
    lay = c.join(syn, "concept_id", "left").filter((F.col("vocabulary_id") == "LAY") | F.col("lay")).select("concept_id", F.col("name").alias("lay_name"))
    e = _t(s, d, "concept_relationship").filter("relationship_id = 'may_be'").select(F.col("concept_id_1").alias("concept_id"), "concept_id_2", "map_priority", "confidence")
    return lay.join(e, "concept_id").join(c.select(F.col("concept_id").alias("concept_id_2"), "code", "name"), "concept_id_2").groupBy("lay_name", "code", "name").agg(F.min("map_priority").alias("map_priority"), F.max("confidence").alias("confidence"))


@query()
def q_hit_rate(s, d):
    """Lookups of the phrases of the labelled sentences, judged by the codes that the labels expect."""
    t = _t(s, d, "annotate_sentences").select(F.lit("t").alias("tbl"), F.col("item_id").alias("row_id"), F.lit("expect").alias("field"), F.col("expect").alias("text"))
    items = packed.unpack(t, {"expect": packed.Rule(tuple(x for x in packed.SEPARATORS if x != "|"), keep_brackets=True)}).filter(F.col("item").contains("="))
    phrase = F.trim(F.regexp_replace(F.split("item", "=", 2)[0], r"^-|\[[^\]]*\]", ""))
    expected = items.select(phrase.alias("query"), F.split("item", "=", 2)[1].alias("expected")).distinct()
    found = lookup.find_codes(expected.select("query").distinct(), _t(s, d, "concept_synonym"), _t(s, d, "concept"), _t(s, d, "concept_relationship"), "ICD10CM")
    return lookup.hit_rate(found, expected)


# -- tables ------------------------------------------------------------------------------

_LAST = "select * from concept_snapshot where concept_id is not null qualify row_number() over (partition by vocabulary_id, code order by snapshot_date desc nulls last, received_at desc nulls last, snapshot_row_id desc) = 1"


def _delivery(s, d):
    rows = _t(s, d, "concept_snapshot").filter("concept_id is not null").select("vocabulary_id", "code", "concept_id", "name", "snapshot_date", "received_at", "snapshot_row_id")
    return tables.last_wins(rows, ["vocabulary_id", "code"], ["snapshot_date", "received_at", "snapshot_row_id"])


@query(_LAST.replace("*", "vocabulary_id, code, concept_id, name, snapshot_row_id", 1))
def q_last_wins(s, d):
    return _delivery(s, d).select("vocabulary_id", "code", "concept_id", "name", "snapshot_row_id")


@query("select concept_id, min_by(name, snapshot_row_id) as name, min(snapshot_row_id) snapshot_row_id from concept_snapshot where concept_id is not null group by 1")
def q_first_wins(s, d):
    rows = _t(s, d, "concept_snapshot").filter("concept_id is not null").select("concept_id", "name", "snapshot_row_id")
    return tables.first_wins(rows, ["concept_id"], ["snapshot_row_id"])


@query(f"""with n as ({_LAST}) select coalesce(o.concept_id, n.concept_id) concept_id, coalesce(o.vocabulary_id, n.vocabulary_id) vocabulary_id, coalesce(o.code, n.code) code,
    case when n.code is not null then n.name else o.name end as name, o.domain, case when n.code is null then o.valid_end end valid_end
    from (select * from concept where vocabulary_id <> 'UMLS') o full join n on o.vocabulary_id = n.vocabulary_id and o.code = n.code""")
def q_upsert(s, d):
    old = _t(s, d, "concept").filter("vocabulary_id <> 'UMLS'").select("concept_id", "vocabulary_id", "code", "name", "domain", "valid_end")
    return tables.upsert(old, _delivery(s, d).select("vocabulary_id", "code", "concept_id", "name"), ["vocabulary_id", "code"], ["name"], ("valid_end",))


@query(f"with n as ({_LAST}) select vocabulary_id, code, name from concept where vocabulary_id = 'ICD10CM' union all select vocabulary_id, code, name from n where (vocabulary_id, code) not in (select (vocabulary_id, code) from concept where vocabulary_id = 'ICD10CM')")
def q_insert_absent(s, d):
    cols = ["vocabulary_id", "code", "name"]
    return tables.insert_absent(_t(s, d, "concept").filter("vocabulary_id = 'ICD10CM'").select(*cols), _delivery(s, d).select(*cols), ["vocabulary_id", "code"])


@query("""select concept_id_1, concept_id_2, relationship_id, source from concept_relationship where source is null or source not like 'MATCH/%'
    union all select distinct concept_id_1, concept_id_2, relationship_id, 'MATCH/again' from concept_relationship where source = 'MATCH/words'""")
def q_refresh_source(s, d):
    cols = ["concept_id_1", "concept_id_2", "relationship_id", "source"]
    e = _t(s, d, "concept_relationship").select(*cols)
    return tables.refresh_source(e, e.filter("source = 'MATCH/words'").withColumn("source", F.lit("MATCH/again")).distinct(), F.col("source").startswith("MATCH/"))


@query("""select concept_id, case when valid_end is null and concept_id not in (select concept_id from concept_snapshot where snapshot_date = (select max(snapshot_date) from concept_snapshot) and concept_id is not null)
    then date '2026-09-30' else valid_end end valid_end from concept where vocabulary_id in ('ICD10CM', 'NS_MSI')""")
def q_retire(s, d):
    snap = _t(s, d, "concept_snapshot")
    newest = snap.agg(F.max("snapshot_date").alias("snapshot_date"))
    present = snap.filter("concept_id is not null").join(F.broadcast(newest), "snapshot_date").select("concept_id")  # one row
    return tables.retire(_t(s, d, "concept").filter(F.col("vocabulary_id").isin("ICD10CM", "NS_MSI")).select("concept_id", "valid_end"), present, ["concept_id"], F.lit("2026-09-30").cast("date"))


@query("""with e as (select code, max(effective_end) as on_day from ns_msi_sample where effective_end is not null and code is not null group by 1)
    select code, on_day as "day" from e where not exists (select 1 from ns_msi_sample f where f.code = e.code and f.effective_start > e.on_day)""")
def q_terminated_codes(s, d):
    fees = _t(s, d, "ns_msi_sample").filter("code is not null")
    ended = fees.filter("effective_end is not null").groupBy("code").agg(F.max("effective_end").alias("day"))
    starts = fees.filter("effective_start is not null").groupBy("code").agg(F.max("effective_start").alias("day"))  # the last start decides
    return tables.terminate(ended, starts, "code")


@query("""with k as (select distinct code from ns_msi_sample where code is not null), o as (select code, min(concept_id) concept_id from concept where vocabulary_id = 'NS_MSI' group by 1), m as (select coalesce(max(concept_id), 0) m from concept where vocabulary_id = 'NS_MSI')
    select k.code, o.concept_id from k join o using (code) union all select code, m + row_number() over (order by code) from (select code from k anti join o using (code)), m""")
def q_assign_ids(s, d):
    known = _t(s, d, "concept").filter("vocabulary_id = 'NS_MSI'").select("code", "concept_id")
    return tables.assign_ids(known, _t(s, d, "ns_msi_sample").filter("code is not null").select("code"), ["code"], "concept_id")


_EDGE = ["concept_id_1", "concept_id_2", "relationship_id"]
_EDGES = "select concept_id_1, concept_id_2, relationship_id, max_by(confidence, edge_id) confidence, max_by(source, edge_id) source from concept_relationship where concept_id_1 is not null and concept_id_2 is not null and {} group by 1, 2, 3"


@query(f"""with o as ({_EDGES.format("coalesce(source, '') not like 'MATCH/%'").replace("max_by(confidence, edge_id)", "max_by({'c': confidence}, edge_id).c").replace("max_by(source, edge_id)", "max_by({'c': source}, edge_id).c")}),
    n as ({_EDGES.format("source like 'MATCH/%'").replace("max_by(confidence, edge_id)", "max_by({'c': confidence}, edge_id).c")})
    select coalesce(o.concept_id_1, n.concept_id_1) concept_id_1, coalesce(o.concept_id_2, n.concept_id_2) concept_id_2, coalesce(o.relationship_id, n.relationship_id) relationship_id,
    case when n.concept_id_1 is not null then n.confidence else o.confidence end confidence, case when n.concept_id_1 is not null then n.source else o.source end source
    from o full join n on o.concept_id_1 = n.concept_id_1 and o.concept_id_2 = n.concept_id_2 and o.relationship_id = n.relationship_id""")
def q_upsert_edges(s, d):
    e = _t(s, d, "concept_relationship").filter("concept_id_1 is not null and concept_id_2 is not null").select(*_EDGE, "confidence", "source", "edge_id")
    match = F.coalesce(F.col("source").startswith("MATCH/"), F.lit(False))
    one = lambda df: tables.last_wins(df, _EDGE, ["edge_id"]).drop("edge_id")
    return tables.upsert(one(e.filter(~match)), one(e.filter(match)), _EDGE, ["confidence", "source"])


@query("""with r as (select fee_row_id line, nullif(trim(units), '') u, nullif(trim(amount), '') a from ns_msi_sample),
    v as (select *, try_cast(regexp_replace(u, '[$,\\s]', '', 'g') as decimal(10,2)) un, try_cast(regexp_replace(a, '[$,\\s]', '', 'g') as decimal(10,2)) an from r)
    select line, un::double units, an::double amount, case when u is not null and un is null then 'line ' || line || ': bad units ' || u when a is not null and an is null then 'line ' || line || ': bad amount ' || a end as error from v""".replace("\\\\", "\\"))
def q_checked_rows(s, d):
    r = _t(s, d, "ns_msi_sample").select(F.col("fee_row_id").alias("line"), "units", "amount")
    return load.checked(r, [], ["units", "amount"]).select("line", F.col("units").cast("double").alias("units"), F.col("amount").cast("double").alias("amount"), "error")


_FEE_KEYS = ["code", "modifier", "locality", "effective_start"]


@query("""with v as (select *, first_value({'u': units, 'a': amount}) over (partition by code, modifier, locality, effective_start order by fee_row_id) f from ns_msi_sample)
    select code, modifier, locality, effective_start, count(*) n_rows, count(*) filter ({'u': units, 'a': amount} is distinct from f) n_conflicts from v group by 1, 2, 3, 4""")
def q_conflicts(s, d):
    return tables.conflicts(_t(s, d, "ns_msi_sample").select(*_FEE_KEYS, "units", "amount", "fee_row_id"), _FEE_KEYS, ["units", "amount"], ["fee_row_id"])


@query("""with n as (select code, description, count(*) n, min(fee_row_id) f from ns_msi_sample where code is not null group by 1, 2)
    select code, description from n qualify row_number() over (partition by code order by coalesce(description <> '', false) desc, n desc, f) = 1""")
def q_name_mode(s, d):
    return tables.mode(_t(s, d, "ns_msi_sample").filter("code is not null").select("code", "description", "fee_row_id"), ["code"], "description", "fee_row_id")


@query("""with p as (select user_id, ts, max_by(value, event_id) v from events where event_type = 'purchase' group by 1, 2)
    select e.event_id, e.user_id, e.ts, p.v as last_value from (select * from events where event_type = 'click') e asof left join p on e.user_id = p.user_id and e.ts >= p.ts""")
def q_asof_value(s, d):
    e = _t(s, d, "events")
    left = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"), F.col("event_id").alias("tie"))
    return tables.asof(left, right, "user_id", "ts", "last_value", "tie")


@query("""with f as (select code, effective_start s, effective_end e, modifier, max(fee_row_id) fee_row_id from ns_msi_sample where effective_start <= date '2022-01-01' and (effective_end is null or effective_end >= date '2022-01-01') group by all)
    select code, modifier, max_by(fee_row_id, {'s': s, 'f': fee_row_id}) fee_row_id from f group by 1, 2""")
def q_in_force(s, d):
    day = F.lit("2022-01-01").cast("date")
    f = _t(s, d, "ns_msi_sample").filter((F.col("effective_start") <= day) & (F.col("effective_end").isNull() | (F.col("effective_end") >= day)))
    return f.groupBy("code", "modifier").agg(F.max_by("fee_row_id", F.struct("effective_start", "fee_row_id")).alias("fee_row_id"))


# -- hierarchy ---------------------------------------------------------------------------


@query("""with c as (select distinct code from concept where vocabulary_id = 'ICD10CM'), n as (select code, unnest(range(3, length(code))) n from c where length(code) > 3)
    select n.code, max_by(p.code, n) parent from n join c p on p.code = n.code[:n] group by 1""")
def q_prefix_parent(s, d):
    return lookup.nearest_prefix(_t(s, d, "concept").filter("vocabulary_id = 'ICD10CM'"))


@query("""with p as (select distinct code printed, regexp_replace(code, '[-.\\s]+$', '') bare from index_term where code is not null), n as (select *, unnest(range(3, length(bare) + 1)) n from p where length(bare) >= 3), c as (select distinct code from concept where vocabulary_id = 'ICD10CM')
    select printed, max_by(c.code, n) code from n join c on c.code = regexp_replace(bare[:n], '[-.]+$', '') group by 1""")
def q_printed_codes(s, d):
    return lookup.resolve_printed(_t(s, d, "index_term").select(F.col("code").alias("printed")), _t(s, d, "concept").filter("vocabulary_id = 'ICD10CM'"))


_OWN = "own as (select distinct concept_id_1 node, concept_id_2 target from concept_relationship where relationship_id in ('mapped_from', 'approx_mapped_from') and concept_id_1 is not null and concept_id_2 is not null)"
_PAR = "par as (select distinct (case relationship_id when 'is_a' then concept_id_1 else concept_id_2 end) node, (case relationship_id when 'is_a' then concept_id_2 else concept_id_1 end) parent from concept_relationship where relationship_id in ('is_a', 'subsumes'))"


@query(f"""with recursive {_OWN}, {_PAR}, nodes as (select concept_id node, lower(name) title, concept_class from concept),
    w as (select o.node origin, case when regexp_matches(title, 'subsequent encounter|sequela') then 0.0 when contains(title, 'open fracture') then 0.5 else 1.0 end w from (select distinct node from own) o join nodes using (node)),
    up as (select w.origin, par.parent node from w join par on par.node = w.origin where par.parent not in (select node from own) union select up.origin, par.parent from up join par using (node) where par.parent not in (select node from own)),
    tot as (select node, sum(w) n from up join w using (origin) group by 1), cnt as (select up.node, own.target, sum(w) c from up join w using (origin) join own on own.node = up.origin group by 1, 2),
    plain as (select node from nodes where coalesce(concept_class, '') not in ('chapter', 'block') and node not in (select node from own))
    select node, target, round(0.7 * (0.5 + 0.5 * (c / n)), 3) confidence from (select cnt.*, tot.n, row_number() over (partition by cnt.node order by c desc, target) r from cnt join tot using (node) where tot.n > 0) join plain using (node) where r <= 5 and c / n >= 0.2
    union all select distinct b.node, k.target, 0.6 from (select node from plain where node not in (select node from tot where n > 0)) b join par using (node)
        join (select parent, target from par join own using (node) join nodes using (node) where contains(title, 'unspecified')) k on k.parent = par.parent""")
def q_derived_mappings(s, d):
    c, e = _t(s, d, "concept"), _t(s, d, "concept_relationship")
    own = e.filter(F.col("relationship_id").isin("mapped_from", "approx_mapped_from") & F.col("concept_id_1").isNotNull() & F.col("concept_id_2").isNotNull()).select(F.col("concept_id_1").alias("node"), F.col("concept_id_2").alias("target")).distinct()
    up = F.col("relationship_id") == "is_a"
    par = e.filter(F.col("relationship_id").isin("is_a", "subsumes")).select(F.when(up, F.col("concept_id_1")).otherwise(F.col("concept_id_2")).alias("node"), F.when(up, F.col("concept_id_2")).otherwise(F.col("concept_id_1")).alias("parent")).distinct()
    return linking.rollup(c.select(F.col("concept_id").alias("node"), F.col("name").alias("title"), "concept_class"), par, own)


# -- linking -----------------------------------------------------------------------------


def _names(s, d) -> linking.Names:
    """All concepts outside of the code vocabularies, LAY among them, against all codes."""
    c = _t(s, d, "concept")
    code = F.col("vocabulary_id").isin("ICD9CM", "NS_MSI", "ICD10CM")
    return linking.Names(c.withColumn("vocabulary_id", F.when(code, F.col("vocabulary_id")).otherwise("UMLS")), _t(s, d, "concept_synonym"))


_CODE = "(c.vocabulary_id in ('ICD10CM', 'ICD9CM', 'NS_MSI'))"
_TGT = f"""tgt as materialized (select c.vocabulary_id, s.concept_id code_id, {_norm('term')} norm, {_key('term')} as key, len(list_intersect({_folded('term')}, ['nos', 'unspecified', 'unspec'])) > 0 unspecified,
        case term_type when 'preferred' then 1.0 when 'clinical' then 0.9 when 'index' then 0.8 else 0.8 end w from concept_synonym s join concept c using (concept_id) where {_CODE} and c.valid_end is null and term is not null)"""
_SRC = f"""src as materialized (select distinct s.concept_id cui, c.domain, {_norm('term')} norm, {_key('term')} as key, case term_type when 'lay' then 0.9 else 1.0 end weight from concept_synonym s join concept c using (concept_id)
        where coalesce(not {_CODE}, true) and c.valid_end is null and term is not null and term_type in ('clinical', 'preferred', 'lay'))"""
_WANT = "want as (select * from src, (values ('ICD10CM'), ('ICD9CM'), ('NS_MSI')) v(vocabulary_id) where (v.vocabulary_id = 'NS_MSI' and domain in ('procedure', 'other', 'observation')) or (v.vocabulary_id <> 'NS_MSI' and domain in ('condition', 'symptom', 'observation', 'other')) or (v.vocabulary_id = 'ICD9CM' and domain = 'procedure'))"
_WIX = "wix as materialized (select vocabulary_id, key, code_id, max({'w': w, 'u': unspecified}) b from tgt where key is not null group by 1, 2, 3 qualify count(*) over (partition by vocabulary_id, key) <= 6)"


@query(f"with {_TGT}, {_SRC}, {_WANT} select cui, code_id, max(round(1.0 * w * weight, 6)) score from want join tgt on tgt.vocabulary_id = want.vocabulary_id and tgt.norm = want.norm group by 1, 2")
def q_name_links(s, d):
    n = _names(s, d)
    return linking.name_offers(n.wanted(), linking.exact_index(n)).groupBy("cui", "code_id").agg(F.max(F.round("score", 6)).alias("score"))


@query(f"with {_TGT}, {_SRC}, {_WANT}, {_WIX} select cui, code_id, max(round(case when b.u then 0.95 else 0.85 end * b.w * weight, 6)) score from want join wix on wix.vocabulary_id = want.vocabulary_id and wix.key = want.key group by 1, 2")
def q_word_links(s, d):
    n = _names(s, d)
    return linking.word_offers(n.wanted(), linking.word_index(n)).groupBy("cui", "code_id").agg(F.max(F.round("score", 6)).alias("score"))


@query(f"""with {_TGT}, {_SRC}, {_WANT}, {_WIX}, lft as materialized (select cui, vocabulary_id, key, max(weight) weight from want where len(key) >= 2 group by all)
    select cui, code_id, max(round(0.6 * b.w * weight * pow(0.9, len(wix.key) - len(lft.key)), 6)) score from lft join wix on wix.vocabulary_id = lft.vocabulary_id and len(wix.key) between len(lft.key) and len(lft.key) + 2
    and list_has_all(wix.key, lft.key) and len(list_intersect(list_intersect(wix.key, {_CTX}), lft.key)) = len(list_intersect(wix.key, {_CTX})) group by 1, 2""")
def q_contained_links(s, d):
    n = _names(s, d)
    left = n.wanted().filter(F.size("key") >= 2).groupBy("cui", "vocabulary_id", "ks").agg(F.first("key").alias("key"), F.max("weight").alias("weight"))
    return linking.contained_offers(left, linking.word_index(n)).groupBy("cui", "code_id").agg(F.max(F.round("score", 6)).alias("score"))


@query(f"""with {_TGT}, {_SRC}, {_WANT}, {_WIX}, drp as (select cui, vocabulary_id, weight, list_filter(key, lambda w: w <> x) rest from (select *, unnest(key) x from want where len(key) >= 2))
    select cui, code_id, max(round(0.55 * b.w * weight, 6)) score from drp join wix on wix.vocabulary_id = drp.vocabulary_id and wix.key = drp.rest
    where len(rest) > 1 or regexp_matches(rest[1], '{X.DISEASE_WORD}') group by 1, 2""")
def q_broader_links(s, d):
    n = _names(s, d)
    left = n.wanted().filter(F.size("key") >= 2).groupBy("cui", "vocabulary_id", "ks").agg(F.first("key").alias("key"), F.max("weight").alias("weight"))
    return linking.broader_offers(left, linking.word_index(n)).groupBy("cui", "code_id").agg(F.max(F.round("score", 6)).alias("score"))


@query()
def q_link(s, d):
    return linking.link(_names(s, d), _t(s, d, "concept_relationship"))


@query(f"select distinct a.concept_id_1 src, b.concept_id_2 dst, round({_CONF.replace('confidence', 'a.confidence', 1).replace('relationship_id', 'a.relationship_id')} * {_CONF.replace('confidence', 'b.confidence', 1).replace('relationship_id', 'b.relationship_id')}, 6) score from concept_relationship a join concept_relationship b on b.concept_id_1 = a.concept_id_2 where a.relationship_id = 'has_umls_cui' and b.relationship_id in ('umls_cui_of', 'may_be')")
def q_two_hops(s, d):
    e = _t(s, d, "concept_relationship")
    a = e.filter("relationship_id = 'has_umls_cui'").select(F.col("concept_id_1").alias("src"), F.col("concept_id_2").alias("mid"), lookup.confidence().alias("x")).distinct()
    b = e.filter(F.col("relationship_id").isin("umls_cui_of", "may_be")).select(F.col("concept_id_1").alias("mid"), F.col("concept_id_2").alias("dst"), lookup.confidence().alias("y")).distinct()
    return a.join(b, "mid").select("src", "dst", F.round(F.col("x") * F.col("y"), 6).alias("score")).distinct()


# -- annotation --------------------------------------------------------------------------


def _terms(s, d):
    c, e = _t(s, d, "concept"), _t(s, d, "concept_relationship")
    linked = e.filter(F.col("relationship_id").isin(lookup.HOPS)).select(F.col("concept_id_1").alias("concept_id")).unionByName(c.filter("vocabulary_id <> 'UMLS'").select("concept_id"))
    return annotate.dictionary(c, _t(s, d, "concept_synonym"), linked)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _weights(col: str, table: dict, default: float) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {default} end"


@query(f"""with c as (select concept_id, name, domain, vocabulary_id from concept where valid_end is null and coalesce(concept_class, '') not in ('chapter', 'block')),
    has as (select distinct concept_id_1 concept_id from concept_relationship where relationship_id in {_HOPS} union select concept_id from concept where vocabulary_id <> 'UMLS'),
    t as materialized (select c.*, s.term, s.term_type, {_norm('s.term')} plain, {_norm(f"regexp_replace(s.term, '{chr(92)}([^)]*{chr(92)})|{chr(92)}[[^{chr(92)}]]*{chr(92)}]', ' ', 'g')")} bare, {_norm('name')} nname, concept_id in (select concept_id from has) linked,
        coalesce({_key('name')} = {_key('s.term')}, false) named, list_filter(string_split({_norm("name || ' ' || s.term")}, ' '), lambda w: regexp_matches(w, '{annotate.CLINICAL_WORD}') and not list_contains({_list(annotate.NOT_CLINICAL)}, w)) clinical
        from (select distinct concept_id, term, term_type from concept_synonym where term is not null) s join c using (concept_id)),
    k as (select *, unnest(list_distinct([plain, bare, case when len(string_split(plain, ' ')) > 2 then array_to_string(list_filter(string_split(plain, ' '), lambda w: not list_contains({_list(X.ARTICLES)}, w)), ' ') else plain end])) as key from t),
    u as (select *, string_split(key, ' ') ws from k where key <> '' and not regexp_matches(key, '^[0-9]+$'))
    select key, concept_id, term_type, max(round({_weights('term_type', annotate.TERM_WEIGHT, 0.8)}::double * {_weights('domain', annotate.DOMAIN_WEIGHT, 0.5)}::double * case when linked then 1.0 else {annotate.UNLINKED} end::double
        * case when vocabulary_id <> 'UMLS' and regexp_matches(name, '(?i){chr(92)}bin (diseases|conditions) classified elsewhere{chr(92)}b') then 0.5 else 1.0 end::double * case when named then 1.0 else {annotate.SECONDARY} end::double, 3)) score,
        bool_or(linked or domain in ('condition', 'symptom') or len(clinical) > 0) keep
    from u where case when len(ws) > 1 then len(list_filter(ws, lambda w: not list_contains({_list(annotate.STOPWORDS)}, w))) > 0 else length(key) >= 2 and not list_contains({_list(annotate.STOPWORDS)}, key) end
        and not (list_contains({_list(annotate.GENERIC)}, key) and nname <> key) group by 1, 2, 3""")
def q_dictionary(s, d):
    return _terms(s, d).select("key", "concept_id", "term_type", "score", "keep")


def _parts(s) -> DataFrame:
    """Body parts of the slots: word, part, adjective, pain."""
    return s.createDataFrame([(p, p, None, f"{p} pain") for p in _PARTS], lexicon.PART)


def _codes(s, d) -> DataFrame:
    return lookup.concept_codes(_t(s, d, "concept"), _t(s, d, "concept_relationship"), ["ICD10CM", "ICD9CM", "NS_MSI"])


def _targets(s, d) -> DataFrame:
    p = _t(s, d, "patterns").select(F.lit("patterns").alias("tbl"), F.col("pattern_id").alias("row_id"), F.lit("targets").alias("field"), F.col("targets").alias("text"))
    return packed.unpack(p).select(F.col("row_id").alias("pattern_id"), "item_pos", "item")


def _mentioned(s, d, docs: DataFrame, cues: bool = False, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mentions by dictionary and lexicon, events of the texts)."""
    if terms is None:
        terms = cut(_terms(s, d))
    lex, parts = cut(lexicon.compiled(_t(s, d, "patterns"))), _parts(s)
    events = annotate.spotted(docs, terms, lex, parts, cues)
    options = lexicon.options(lexicon.found(events, lex), _targets(s, d), parts, terms, _t(s, d, "concept"), _codes(s, d))
    return annotate.mentions(docs, terms, options, events), events


def _kinds(s, d) -> DataFrame:
    """concept_id, code, chapter, word_key: what votes and contexts read of a concept."""
    c = _t(s, d, "concept")
    best = lookup.concept_codes(c, _t(s, d, "concept_relationship"), ["ICD10CM"], 1).select("concept_id", F.col("code").alias("best"))
    return c.join(best, "concept_id", "left").select("concept_id", F.col("best").alias("code"), annotate.chapter(F.col("best"), F.col("domain")).alias("chapter"), F.array_join(X.word_set(F.col("name"))["key"], " ").alias("word_key"))


def _senses(s, d) -> DataFrame:
    """term, target, cue."""
    senses = _t(s, d, "senses")
    cues = packed.unpack(senses.select(F.lit("senses").alias("tbl"), F.col("sense_id").alias("row_id"), F.lit("cues").alias("field"), F.col("cues").alias("text")), {"cues": packed.Rule(unwrap=True)})
    return senses.join(cues, F.col("sense_id") == F.col("row_id")).select("term", "target", F.col("item").alias("cue"))


def _annotated(s, d, docs: DataFrame) -> DataFrame:
    """Mentions in context, settled, with codes and those of history and family in their place.

    Mentions carry the ref of what they stand for. Candidates and codes are made once per ref and met at the end."""
    concept = _t(s, d, "concept")
    terms, codes = cut(_terms(s, d)), cut(_codes(s, d))
    top = freed(annotate.top_candidates(terms))
    lex, parts = cut(lexicon.compiled(_t(s, d, "patterns"))), _parts(s)
    events = annotate.spotted(docs, terms, lex, parts, True)
    hits = cut(lexicon.found(events, lex))
    choices = freed(lexicon.choices(hits, _targets(s, d), parts, top, concept, codes))
    lexical = hits.withColumn("ref", lexicon.ref()).join(maybe_broadcast(choices.select("ref", "suppressed")), "ref").select("doc_id", "i", "n", "suppressed", "ref")
    m = freed(annotate.mentions(docs, terms, lexical, events, top))
    context = freed(annotate.contexts(m, events).drop("cues"))
    kinds = cut(_kinds(s, d))
    meanings = freed(annotate.meanings(top, choices).join(maybe_broadcast(m.select("ref").distinct()), "ref", "left_semi"))
    told = annotate.sense_hits(m, docs, _senses(s, d)).filter("settled").select("doc_id", "i", X.normalize(F.col("target")).alias("key"))
    told = told.join(maybe_broadcast(top.select("key", F.col("candidates")[0]["concept_id"].alias("concept_id"))), "key").groupBy("doc_id", "i").agg(F.min("concept_id").alias("sense"))
    told = freed(told)
    voted = annotate.settle(m.select("doc_id", "i", "ref").join(maybe_broadcast(annotate.pairs(meanings, kinds.drop("code"), ["ref"])), "ref").drop("ref"))
    picked = voted.join(told, ["doc_id", "i"], "left").select("doc_id", "i", F.coalesce("sense", "concept_id").alias("_p"), (F.col("ambiguous") & F.col("sense").isNull()).alias("ambiguous"))
    # each candidate of a ref with its codes
    each = meanings.select("ref", F.posexplode(F.transform("candidates", lambda c: c["concept_id"])).alias("k", "concept_id"), "extra")
    each = each.select(F.col("ref").alias("doc_id"), F.col("k").alias("i"), F.array(F.struct("concept_id")).alias("candidates"), "extra")
    each = annotate.with_codes(each, codes).withColumn("concept_id", F.col("candidates")[0]["concept_id"]).join(kinds.select("concept_id", "word_key", "code"), "concept_id", "left")
    each = freed(each.groupBy(F.col("doc_id").alias("ref")).agg(F.array_sort(F.collect_list(F.struct("i", "concept_id", "codes", "word_key", "code"))).alias("each")))  # at most MAX_CANDIDATES
    best = F.coalesce(F.try_element_at(F.filter("each", lambda c: c["concept_id"] == F.col("_p")), F.lit(1)), F.col("each")[0])
    m = m.join(context, ["doc_id", "i"], "left").join(picked, ["doc_id", "i"]).join(maybe_broadcast(each), "ref").withColumn("best", best)
    ids = F.concat(F.array(F.struct("best.concept_id")), F.transform(F.filter("each", lambda c: c["i"] != F.col("best.i")), lambda c: F.struct(c["concept_id"].alias("concept_id"))))
    coded = freed(m.select("doc_id", "i", "n", "start", "end", "text", "assertion", "experiencer", "temporality", "ambiguous", ids.alias("candidates"), "best.codes", "best.word_key", "best.code"))
    switched = annotate.context_codes(coded.select("doc_id", "i", "assertion", "experiencer", "temporality", "word_key", "code"), annotate.history_titles(concept))
    return annotate.in_context(coded.drop("word_key", "code"), switched)


@query()
def q_mentions(s, d):
    m, _ = _mentioned(s, d, _t(s, d, "documents").select("doc_id", "text"))
    return m.select("doc_id", "start", "end", "text", F.col("candidates")[0]["concept_id"].alias("concept_id"), F.size("candidates").alias("n_candidates"))


@query()
def q_mentions_in_context(s, d):
    docs = _t(s, d, "annotate_sentences").select(F.col("item_id").alias("doc_id"), "text").unionByName(_t(s, d, "documents").select((-F.col("doc_id")).alias("doc_id"), "text"))
    found, events = _mentioned(s, d, docs, cues=True)
    m = annotate.with_context(found, docs, events)
    return m.select("doc_id", "start", "end", "text", "assertion", "experiencer", "temporality", F.array_join("cues", "; ").alias("cues"))


@query()
def q_settled_mentions(s, d):
    m, _ = _mentioned(s, d, _t(s, d, "documents").select("doc_id", "text"))
    return annotate.vote(m, _kinds(s, d).drop("code"))


@query()
def q_annotations(s, d):
    m = _annotated(s, d, _t(s, d, "documents").select("doc_id", "text"))
    shown = F.array_join(F.transform("codes", lambda c: F.concat_ws(":", c["vocabulary_id"], c["code"])), " ")
    return m.select("doc_id", "start", "end", "text", F.col("candidates")[0]["concept_id"].alias("concept_id"), "assertion", "experiencer", "temporality", "ambiguous", shown.alias("codes"), F.col("condition_codes").isNotNull().alias("switched"))


@query()
def q_annotation_quality(s, d):
    """Expected and forbidden items of the labelled sentences, and how many annotation hits."""
    t = _t(s, d, "annotate_sentences")
    m = _annotated(s, d, t.select(F.col("item_id").alias("doc_id"), "text"))
    three = m.select("doc_id", "i", F.explode(F.slice("candidates", 2, 2)).alias("c")).select("doc_id", "i", "c.concept_id").join(_codes(s, d), "concept_id").select("doc_id", "i", "code")
    codes = m.select("doc_id", "i", F.explode("codes").alias("c")).select("doc_id", "i", "c.code").unionByName(three)
    fields = lambda f: t.select(F.lit("t").alias("tbl"), F.col("item_id").alias("row_id"), F.lit(f).alias("field"), F.col(f).alias("text"))
    rule = {"expect": packed.Rule(tuple(x for x in packed.SEPARATORS if x != "|"), keep_brackets=True)}
    items = cut(packed.unpack(fields("expect").unionByName(fields("forbid")), rule).select("field", F.col("row_id").alias("item_id"), "item_pos", "item"))
    got = annotate.judge(m, codes, items.filter("field = 'expect'").drop("field"), items.filter("field = 'forbid'").drop("field"))
    return got.groupBy("kind").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col("hit").cast("bigint")).alias("n_hit"))


@query()
def q_unresolved_targets(s, d):
    return lexicon.unresolved(_targets(s, d), _parts(s), _terms(s, d), _t(s, d, "concept"))


@query()
def q_sense_hits(s, d):
    docs = _t(s, d, "documents").select("doc_id", "text")
    senses = freed(_senses(s, d))
    keys = senses.filter("term is not null").select(X.normalize(F.col("term")).alias("key"), F.lit(False).alias("abbreviation_only")).distinct()
    events = annotate.spotted(docs, keys)
    found = annotate.leftmost_longest(annotate.dictionary_spans(events, keys)).drop("lit").withColumnRenamed("key", "text")
    return annotate.sense_hits(found, docs, senses)


@query()
def q_lexicon_sequences(s, d):
    return lexicon.sequences(_t(s, d, "patterns")).select("pattern_id", "seq_no", F.array_join("seq", " ").alias("seq"))


_PARTS = ("knee wrist hip ankle elbow shoulder jaw neck scalp heel toe thumb finger forearm femur tibia fibula radius ulna humerus scapula clavicle sternum patella sacrum coccyx "
          "kidney liver spleen pancreas stomach colon rectum bladder prostate uterus ovary tongue larynx trachea bronchus pleura diaphragm thyroid tonsil sinus eyelid cornea retina "
          "eardrum tendon meniscus gallbladder duodenum ileum ureter urethra parotid oesophagus palate").split()


@query()
def q_lexicon_matches(s, d):
    return lexicon.matches(_t(s, d, "documents").select("doc_id", "text"), _t(s, d, "patterns"), _PARTS)


# -- windows and extraction --------------------------------------------------------------


@query("""with l as (select user_id, ts, event_id, case when date_diff('microsecond', lag(ts) over w, ts) <= 14400000000 then 0 else 1 end fresh from events window w as (partition by user_id order by ts, event_id))
    select event_id, user_id, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint line_no from l""")
def q_line_groups(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.when(us - F.lag(us).over(w) <= 14_400_000_000, 0).otherwise(1)
    e = _t(s, d, "events").select("event_id", "user_id", "ts", fresh.alias("fresh"))
    return e.select("event_id", "user_id", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("line_no"))


@query("""select record_id, last_value(heading ignore nulls) over w as heading, last_value(section ignore nulls) over w as section from fee_record window w as (partition by feed, payer order by page, x0, record_id rows between unbounded preceding and current row)""")
def q_carry_forward(s, d):
    f = _t(s, d, "fee_record").select("record_id", "feed", "payer", "page", "x0", "heading", "section")
    order = [F.coalesce("x0", F.lit(float("inf"))), F.col("record_id")]
    return tables.carry_forward(f, ["feed", "payer"], F.coalesce("page", F.lit(2**31 - 1)), order, ["heading", "section"]).select("record_id", "heading", "section")


@query("select feed, page, arg_min(section, {'x': coalesce(x0, 1e300), 'r': record_id}) as section, count(*) n_records, count(distinct code) n_codes from fee_record where section is not null group by 1, 2")
def q_first_on_page(s, d):
    f = _t(s, d, "fee_record").filter("section is not null")
    return f.groupBy("feed", "page").agg(F.min_by("section", F.struct(F.coalesce("x0", F.lit(1e300)), "record_id")).alias("section"), F.count(F.lit(1)).alias("n_records"), F.count_distinct("code").alias("n_codes"))


@query("""with p as (select distinct parent_code prefix from release_parent where parent_code <> ''), c as (select distinct code from concept where code <> '')
    select c.code, max_by(prefix, length(prefix)) prefix from c join p on starts_with(c.code, prefix) group by 1""")
def q_longest_prefix(s, d):
    return lookup.longest_prefix(_t(s, d, "concept"), _t(s, d, "release_parent").select(F.col("parent_code").alias("prefix")))


@query("select source, relationship_id, count(*) n, count(confidence) n_confident, round(avg(confidence), 6) mean_confidence, min(map_priority) best_priority from concept_relationship where source not in ('UMLS/ICD9CM', 'UMLS/ICD10CM') group by 1, 2")
def q_source_counts(s, d):
    e = _t(s, d, "concept_relationship").filter(~F.col("source").isin("UMLS/ICD9CM", "UMLS/ICD10CM"))
    return e.groupBy("source", "relationship_id").agg(F.count(F.lit(1)).alias("n"), F.count("confidence").alias("n_confident"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("map_priority").alias("best_priority"))


@query("""select r.edge_id from concept_relationship r where r.concept_id_2 not in (select concept_id from concept)""")
def q_missing_targets(s, d):
    e = _t(s, d, "concept_relationship").filter("concept_id_2 is not null")
    return e.join(_t(s, d, "concept").select(F.col("concept_id").alias("concept_id_2")), "concept_id_2", "left_anti").select("edge_id")


@query("""select concept_id, min(case domain when 'condition' then 1 when 'symptom' then 2 when 'procedure' then 3 when 'drug' then 4 when 'observation' then 5 else 9 end)::int domain_rank,
    count(distinct t.vocabulary_id) n_vocabularies from concept c join concept_relationship r on r.concept_id_1 = c.concept_id join (select concept_id target, vocabulary_id from concept) t on t.target = r.concept_id_2 group by 1""")
def q_reach(s, d):
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in {"condition": 1, "symptom": 2, "procedure": 3, "drug": 4, "observation": 5}.items() for x in kv]), F.col("domain")), F.lit(9))
    c = _t(s, d, "concept")
    e = _t(s, d, "concept_relationship").select(F.col("concept_id_1").alias("concept_id"), "concept_id_2")
    t = c.select(F.col("concept_id").alias("concept_id_2"), "vocabulary_id")
    j = c.select("concept_id", rank.alias("r")).join(e, "concept_id").join(maybe_broadcast(t), "concept_id_2")
    return j.groupBy("concept_id").agg(F.min("r").cast("int").alias("domain_rank"), F.count_distinct("vocabulary_id").alias("n_vocabularies"))
