"""The pN_ queries over the test tables, and the same in SQL where SQL can say it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 64  #: elements of a usable vector in ``sections``


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _sections_texts(spark: SparkSession, d: str) -> DataFrame:
    parsed = _read(spark, d, "parsed_sections").select(F.lit("text").alias("field"), F.col("section_key").alias("key"), "text")
    previews = _read(spark, d, "sections").select(F.lit("text_preview").alias("field"), F.col("global_idx").cast("long").alias("key"), F.col("text_preview").alias("text"))
    return parsed.unionByName(previews)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.llm.neardup import expanded, near_duplicates

    found = near_duplicates(_sections_texts(spark, d), "key", "text", within="field", k=3, similarity=0.6, least_words=12)
    return expanded(found).withColumnRenamed("within", "field")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicates by the defaults, five words and 0.8: each text's class of copies and its number of links."""
    from quillstone.llm.neardup import classes_with_links, near_duplicates

    return classes_with_links(near_duplicates(_sections_texts(spark, d), "key", "text", within="field")).withColumnRenamed("within", "field")



def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.llm.vectors import most_similar

    return most_similar(_read(spark, d, "sections"), "global_idx", "embedding", DIM, k=5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = p2_neighbours(spark, d)
    return near.select(F.least("id", "neighbour").alias("idx_a"), F.greatest("id", "neighbour").alias("idx_b")).distinct()


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same without a miss; a cosine that equals the fifth one's to nine places counts as it."""
    from quillstone.llm.vectors import most_similar

    near = most_similar(_read(spark, d, "sections"), "global_idx", "embedding", DIM, k=5, exact=True)
    return near.select("id", "rank", F.round("cosine", 6).alias("cosine"))


def _typed(spark: SparkSession, d: str, which: str) -> tuple[DataFrame, list[dict]]:
    from quillstone.llm.canonical import listed, typed_values

    sections = _read(spark, d, "parsed_sections")
    if which == "agency":
        names = listed(_read(spark, d, "agency_list"), "agency_id", "name", acronym="acronym", former_names="former_names")
        return typed_values(sections, "section_key", F.col("agencies"), "agency", names), names
    names = listed(_read(spark, d, "reference_list"), "ref_id", "reference")
    return typed_values(sections, "section_key", F.col("citations.reference"), "citation", names), names


def _mapped(spark: SparkSession, d: str, how: str) -> DataFrame:
    from quillstone.llm import canonical as c

    bodies, names = _typed(spark, d, "agency")
    citations, references = _typed(spark, d, "citation")
    use = getattr(c, how)
    found = use(bodies, "value", names, c.body_entries, c.body_readings)
    return found.unionByName(use(citations, "value", references, c.citation_entries, c.citation_readings)).distinct()


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Every typed value that is not a listed one letter for letter, with the entry it denotes."""
    return _mapped(spark, d, "map_values")


def p3_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All entries within the distance of each typed value."""
    return _mapped(spark, d, "candidates")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_values(spark, d).select("section_key", "field", "pos", "entry_id").distinct()


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that name no entry, with how often they occur."""
    none = p3_values(spark, d).where("entry_id = 'none'")
    return none.groupBy("field", "value").agg(F.count("*").alias("n"))



def _groups(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.llm.clusters import similarity_groups

    return similarity_groups(_read(spark, d, "sections"), "global_idx", "embedding", "heading", DIM, threshold=0.85)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select("cluster_key", F.col("id").alias("global_idx"))


def p4_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The groups of usable rows alone, without those placed by heading."""
    from quillstone.llm.clusters import similarity_groups

    found = similarity_groups(_read(spark, d, "sections"), "global_idx", "embedding", None, DIM, threshold=0.85)
    return found.select("cluster_key", F.col("id").alias("global_idx"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.llm.clusters import describe_groups
    from quillstone.session import materialize

    return describe_groups(materialize(_groups(spark, d), "groups"), _read(spark, d, "sections"), "global_idx", "embedding", "heading", DIM)


def p4_average(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of average linkage at the same threshold, of three usable rows and more."""
    from quillstone.llm.clusters import average_groups
    from quillstone.session import materialize

    rows = materialize(average_groups(_read(spark, d, "sections"), "global_idx", "embedding", DIM, threshold=0.85), "average")
    large = rows.groupBy("cluster_key").count().where("count >= 3").select("cluster_key")
    return rows.join(large, "cluster_key").select("cluster_key", F.col("id").alias("global_idx"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.llm.split import split_texts

    pieces = split_texts(_read(spark, d, "parsed_sections"), "section_key", "text", only_long=True)
    return pieces.select("section_key", "piece_no", "start_pos", "end_pos").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves, of all texts."""
    from quillstone.llm.split import split_texts

    pieces = split_texts(_read(spark, d, "parsed_sections"), "section_key", "text", with_text=True)
    return pieces.select("section_key", "piece_no", F.length("piece").alias("n_chars"), F.md5(F.col("piece").cast("binary")).alias("digest")).distinct()


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.llm.leaks import find_leaks

    return find_leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.llm.leaks import leaked_pairs

    return leaked_pairs(p6_spans(spark, d))


def _mix(spark: SparkSession, d: str):
    from quillstone.llm.mixing import plan_mix

    return plan_mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.llm.mixing import drawn_passes

    return drawn_passes(_mix(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.llm.mixing import mixed

    return mixed(_mix(spark, d))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.llm.mixing import shares

    return shares(_mix(spark, d))


def p7_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each source's target and whether the records that were drawn meet it, or all that max_passes allows, to a
    thousandth of the source."""
    s = p7_shares(spark, d)
    due = F.least("target_tokens", F.col("max_passes") * F.col("tokens"))
    return s.select("source", "max_passes", "full_passes", "tokens", F.round("target_tokens", 3).alias("target_tokens"), (F.abs(F.col("mixed_tokens") - due) <= 0.001 * F.col("tokens") + 200).alias("met"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    labels = _read(spark, d, "subject_labels")
    found = p8_subjects(spark, d)
    return found.join(labels.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti").select("doc_id", "subject_id").distinct()


def p8_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Every document's subjects with their shares of its subject-bearing sentences."""
    from quillstone.llm.subjects import assign_subjects

    return assign_subjects(_read(spark, d, "documents"), _read(spark, d, "subject_labels"), _read(spark, d, "subject_areas"))


def p8_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The clusters that documents are put into: mixtures of subjects and discriminative terms."""
    from quillstone.llm.subjects import describe_leaves, fit_subjects

    model = fit_subjects(_read(spark, d, "documents"), _read(spark, d, "subject_labels"), _read(spark, d, "subject_areas"))
    return describe_leaves(model, spark)


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents, their sentences and the mean share."""
    return p8_subjects(spark, d).groupBy("subject_id").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"), F.round(F.avg("share"), 6).alias("mean_share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_neighbours, p2_exact, p3_found, p3_values, p3_candidates, p3_unmatched, p4_found, p4_clusters, p4_vectors, p4_average, p5_found, p5_pieces, p6_found, p6_spans, p7_found, p7_mix, p7_shares, p7_targets, p8_found, p8_subjects, p8_leaves, p8_composition)}

ORACLES: dict[str, str] = {}

ORACLES["p7_found"] = r"""
with d as (select translate(lower(trim(source)), ' -', '__') as source, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\v\f\r]+')) as n from documents),
s as (select t.source, max(t.target_share) as share, max(t.max_passes) as most, sum(d.n) as tokens from mix_targets t join d on d.source = t.source group by t.source),
m as (select *, sum(tokens) over () as size from s)
select source, cast(least(most, floor(share * size / tokens)) as integer) as full_passes from m where tokens > 0
"""

ORACLES["p7_targets"] = r"""
with d as (select translate(lower(trim(source)), ' -', '__') as source, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\v\f\r]+')) as n from documents),
s as (select t.source, max(t.target_share) as share, max(t.max_passes) as most, coalesce(sum(d.n), 0) as tokens from mix_targets t left join d on d.source = t.source group by t.source),
m as (select *, sum(tokens) over () as size from s)
select source, most as max_passes, cast(case when tokens > 0 then least(most, floor(share * size / tokens)) else 0 end as integer) as full_passes, cast(tokens as bigint) as tokens, round(share * size, 3) as target_tokens, true as met from m
"""

_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"

ORACLES["p1_found"] = f"""
with texts as (
  select 'text' as field, section_key as key, {_WORDS.format("text")} as w from (select distinct section_key, text from parsed_sections where text is not null)
  union all select 'text_preview', cast(global_idx as bigint), {_WORDS.format("text_preview")} from (select distinct global_idx, text_preview from sections where text_preview is not null)),
sets as (select distinct field, key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select field, key, w, unnest(range(1, len(w) - 1)) as i from texts where len(w) >= 12)),
sizes as (select field, key, count(*) as n from sets group by field, key),
met as (select a.field, a.key as key_a, b.key as key_b, count(*) as k from sets a join sets b on a.field = b.field and a.s = b.s and a.key < b.key group by all)
select b.field, key_a, key_b from met b join sizes x on x.field = b.field and x.key = key_a join sizes y on y.field = b.field and y.key = key_b where k >= 0.6 * (x.n + y.n - k) - 1e-9
"""

ORACLES["p6_found"] = f"""
with items as (select item_id, {_WORDS.format("text")} as w from eval_items where text is not null),
phrases as (
  select distinct item_id, 12 as n, array_to_string(w[i:i + 11], ' ') as p from (select item_id, w, unnest(range(1, len(w) - 10)) as i from items where len(w) >= 12)
  union select item_id, len(w), array_to_string(w, ' ') from items where len(w) between 1 and 11),
docs as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null),
runs as (select doc_id, n, array_to_string(w[i:i + n - 1], ' ') as p from (select doc_id, w, n, unnest(range(1, cast(len(w) - n + 2 as bigint))) as i from docs, (select distinct n from phrases)))
select distinct doc_id, item_id from runs join phrases using (n, p)
"""

ORACLES["p1_classes"] = f"""
with texts as (
  select 'text' as field, section_key as key, {_WORDS.format("text")} as w from (select distinct section_key, text from parsed_sections where text is not null)
  union all select 'text_preview', cast(global_idx as bigint), {_WORDS.format("text_preview")} from (select distinct global_idx, text_preview from sections where text_preview is not null)),
members as (select field, key, w, min(key) over (partition by field, array_to_string(w, ' ')) as class_id from texts where len(w) >= 5),
sets as (select distinct field, key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as s from (select field, key, w, unnest(range(1, len(w) - 3)) as i from members where key = class_id)),
sizes as (select field, key, count(*) as n from sets group by field, key),
met as (select a.field, a.key as a, b.key as b, count(*) as k from sets a join sets b on a.field = b.field and a.s = b.s and a.key < b.key group by all),
linked as (select m.field, a, b from met m join sizes x on x.field = m.field and x.key = a join sizes y on y.field = m.field and y.key = b where k >= 0.8 * (x.n + y.n - k) - 1e-9),
degrees as (select field, x, count(*) as links from (select field, a as x from linked union all select field, b from linked) group by field, x)
select m.field, key, class_id, coalesce(links, 0) as links from members m left join degrees d on d.field = m.field and d.x = m.class_id
"""

ORACLES["p4_vectors"] = """
with recursive u as materialized (select distinct cast(global_idx as bigint) as id, embedding::double[] as e from sections where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.id as a, b.id as b from u a join u b on list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.85),
r(id, root) as (select id, id from u union select l.b, r.root from r join l on l.a = r.id where r.root <= l.b),
c as (select id, min(root) as cluster_key from r group by id)
select cluster_key, id as global_idx from c where cluster_key in (select cluster_key from c group by 1 having count(*) >= 3)
"""

ORACLES["p6_spans"] = f"""
with items as (select item_id, {_WORDS.format("text")} as w from eval_items where text is not null),
phrases as (
  select distinct item_id, 12 as n, array_to_string(w[i:i + 11], ' ') as p from (select item_id, w, unnest(range(1, len(w) - 10)) as i from items where len(w) >= 12)
  union select item_id, len(w), array_to_string(w, ' ') from items where len(w) between 1 and 11),
docs as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null),
runs as (select doc_id, n, i - 1 as b, array_to_string(w[i:i + n - 1], ' ') as p from (select doc_id, w, n, unnest(range(1, cast(len(w) - n + 2 as bigint))) as i from docs, (select distinct n from phrases))),
hits as (select distinct doc_id, item_id, b, b + n as e from runs join phrases using (n, p)),
marked as (select *, case when b <= max(e) over (partition by doc_id, item_id order by b, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from hits),
spans as (select *, sum(new) over (partition by doc_id, item_id order by b, e rows unbounded preceding) as s from marked)
select doc_id, item_id, min(b) as first_word, max(e) as end_word from spans group by doc_id, item_id, s
"""

ORACLES["p2_exact"] = """
with u as (select distinct global_idx as id, embedding::double[] as e from sections where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.id, b.id as other, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) as c from u a join u b on a.id <> b.id),
r as (select id, c, row_number() over (partition by id order by c desc, other) as k from p)
select cast(id as bigint) as id, cast(k as integer) as rank, round(c, 6) as cosine from r where k <= 5
"""

_LAST = "list_max(list_filter(range(s + 1025, s + 2049), lambda x: {0}))"
_BLANK = "c[{0}] in (' ', chr(9), chr(10), chr(13))"
_END = (
    "case when n - s <= 2048 then n else coalesce("
    + ", ".join(_LAST.format(x) for x in ("c[x] = chr(10) and c[x - 1] = chr(10)", "c[x] = chr(10)", _BLANK.format("x") + " and c[x - 1] in ('.', '!', '?')", _BLANK.format("x")))
    + ", s + 2048) end"
)

_PIECES = f"""
with recursive t as materialized (select section_key, text, regexp_extract_all(text, '(?s).') as c, cast(length(text) as bigint) as n from (select distinct section_key, text from parsed_sections where length(text) > {{0}})),
r(section_key, piece_no, s, e) as (
  select section_key, 0, s, {_END} from (select *, cast(0 as bigint) as s from t)
  union all
  select section_key, piece_no + 1, s, {_END} from (select t.section_key, r.piece_no, t.c, t.n, coalesce(list_min(list_filter(range(r.e - 200, r.e), lambda x: {_BLANK.format("x")})), r.e - 200) as s from r join t on t.section_key = r.section_key where r.e < t.n))
"""
ORACLES["p5_found"] = _PIECES.format(2048) + "select section_key, cast(piece_no as integer) as piece_no, s as start_pos, e as end_pos from r"
ORACLES["p5_pieces"] = _PIECES.format(0) + "select section_key, cast(piece_no as integer) as piece_no, cast(e - s as integer) as n_chars, md5(substring(text, s + 1, e - s)) as digest from r join t using (section_key)"
