"""Registered near-duplicate, vector and set queries (survey part 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsieve.functions import text as t
from twinsieve.functions import vocab as v
from twinsieve.functions.hashing import order_key, pick
from twinsieve.functions.sketches import permutations
from twinsieve.operators import corpus as c
from twinsieve.operators import metrics as m
from twinsieve.operators import neardup as nd
from twinsieve.operators import overlap as ov
from twinsieve.operators import phrases as ph
from twinsieve.operators import vectors as vec
from twinsieve.plans.filters import CARRIER_SQL, MARKER_SQL, PAYLOAD_SQL, PLAIN_SQL, docs, planted
from twinsieve.plans.fixture_sql import CORPUS, hashed, with_
from twinsieve.plans.metrics import rnd
from twinsieve.plans.registry import query
from twinsieve.plans.text_sql import norm_neardup, planted_cte, q, shingles, squeeze, strip
from twinsieve.sources import readers as r
from twinsieve.sources.tables import corpus, table


def halves(df, ident, *cols):
    """Candidates (odd ids) and references (even ids); together they are the whole table."""
    x = df.select(F.col(ident).alias("id"), *cols)
    return x.filter("id % 2 = 1"), x.filter("id % 2 = 0")


def doc_sides(spark, d):
    return halves(docs(spark, d), "doc_id", "text")


def vec_sides(spark, d):
    return halves(table(spark, d, "embeddings"), "vec_id", F.col("embedding").alias("vec"))


# Gram sets of all documents and the exact Jaccard of every (odd, even) pair that shares a gram.
GRAMS = f"""gs as (select doc_id, unnest({shingles('x')}) as g from (select doc_id, {norm_neardup('text')} as x from documents)),
  sz as (select doc_id, count(*) as n from gs group by 1)"""
JAC = """pj as (select a.doc_id as id, b.doc_id as match_id, count(*) as c from gs a join gs b on a.g=b.g and a.doc_id%2=1 and b.doc_id%2=0 group by 1,2),
  jj as (select id, match_id, c*1e0/(x.n+y.n-c) as jac from pj join sz x on x.doc_id=id join sz y on y.doc_id=match_id)"""
NEAR_SQL = "with " + GRAMS + "," + JAC + """ select id, arg_max(match_id, (jac, -match_id)) as match_id, round(max(jac),6) as jac from jj where jac>=0.5e0 group by 1"""


@query("neardup_lsh", NEAR_SQL)
def neardup_lsh(spark, d):
    return rnd(nd.near_duplicates(*doc_sides(spark, d)), "jac")


@query("neardup_exact", NEAR_SQL)
def neardup_exact(spark, d):
    return rnd(nd.near_duplicates(*doc_sides(spark, d), exact=True), "jac")


KNN = """dots as (select a.vec_id as id, b.vec_id as match_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]),9) as cos from embeddings a join embeddings b on a.vec_id%2=1 and b.vec_id%2=0),
  nn as (select * from (select *, row_number() over (partition by id order by cos desc, match_id) as place from dots) where place<=10)"""


@query("cosine_join", "with " + KNN + " select id, match_id, round(cos,6) as cos from nn where place=1")
def cosine_join(spark, d):
    return rnd(vec.knn(*vec_sides(spark, d), 1).select("id", "match_id", "cos"), "cos")


@query("topk_neighbours", "with " + KNN + " select id, match_id, round(cos,6) as cos, place::int as place from nn")
def topk_neighbours(spark, d):
    return rnd(vec.knn(*vec_sides(spark, d), 10), "cos")


@query("jaccard_verify", "with " + KNN + "," + GRAMS + """, pp as (select nn.id, nn.match_id, count(y.g) as c from nn left join gs x on x.doc_id=nn.id left join gs y on y.doc_id=nn.match_id and y.g=x.g group by 1,2)
  select id, match_id, round(c*1e0/(a.n+b.n-c),6) as jac from pp join sz a on a.doc_id=id join sz b on b.doc_id=match_id""")
def jaccard_verify(spark, d):
    near = vec.knn(*vec_sides(spark, d), 10)
    cands, refs = doc_sides(spark, d)
    return rnd(nd.verify(near.select("id", "match_id"), nd.normalised(cands), nd.normalised(refs)), "jac")


def _step(h, code):
    return f"(({h}::uhugeint * 11400714819323198485::uhugeint + ({code})::uhugeint) % 18446744073709551616::uhugeint)"


def _mix_sql(x, shift, factor=None):
    y = f"xor({x}, {x} >> {shift})"
    return y if factor is None else f"(({y}::uhugeint * {factor}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"


def minhash_ctes(grams, key, tag):
    """CTE ``{tag}_bands(id, band, b)``: the bands that the sketch of ``functions.sketches`` gives, in SQL."""
    mult, add = permutations(3131)
    h = "least(length(g), 5)"
    for j in range(1, 6):
        h = f"(case when length(g) >= {j} then {_step(h, f'unicode(substr(g,{j},1))')} else {h}::uhugeint end)"
    return f"""{tag}_h0 as (select g, ({h})::ubigint as h from (select distinct g from {grams})),
  {tag}_h1 as (select g, {_mix_sql('h', 30, 13787848793156543929)} as h from {tag}_h0), {tag}_h2 as (select g, {_mix_sql('h', 27, 10723151780598845931)} as h from {tag}_h1),
  {tag}_x as materialized (select distinct s.{key} as id, ({_mix_sql('h', 31)} >> 32)::ubigint as x from {grams} s join {tag}_h2 using (g)),
  {tag}_p as (select unnest(range(256)) as i, unnest({[int(v) for v in mult]}::ubigint[]) as a, unnest({[int(v) for v in add]}::ubigint[]) as c),
  {tag}_m as (select id, i, min((a*x+c) % 4294967296) as v from {tag}_x, {tag}_p group by 1,2),
  {tag}_bands as materialized (select id, i//4 as band, list(v order by i) as b from {tag}_m group by 1,2)"""


VERDICT_SQL = """coalesce(cos,-1)>=0.95e0 or jac>=0.5e0 as remove, round(cos,4) as cos, round(jac,4) as jac, nullif(concat_ws('+', case when cos>=0.95e0 then 'cosine' end, case when jac>=0.5e0 then 'char5gram_jaccard' end),'') as reason,
  case when coalesce(cos,-1)>=jac then cm else jm end as match_id"""
SCREEN = "with " + KNN + "," + GRAMS + "," + JAC + "," + minhash_ctes("gs", "doc_id", "mh") + f""",
  cand as (select distinct a.id, b.id as match_id from mh_bands a join mh_bands b using (band, b) where a.id%2=1 and b.id%2=0 union select id, match_id from nn),
  bj as (select id, arg_max(match_id, (coalesce(jac,0e0), -match_id)) as jm, max(coalesce(jac,0e0)) as jac from cand left join jj using (id, match_id) group by 1),
  sv as (select d.doc_id as id, n.cos, n.match_id as cm, coalesce(bj.jac,0e0) as jac, bj.jm from documents d left join (select * from nn where place=1) n on n.id=d.doc_id left join bj on bj.id=d.doc_id where d.doc_id%2=1)
  select id, {VERDICT_SQL} from sv"""


@query("neardup_screen", SCREEN)
def neardup_screen(spark, d):
    cands, refs = doc_sides(spark, d)
    return nd.screen(cands, refs, vec.knn(*vec_sides(spark, d), 10))


@query("sink_split_removed", "with v as (" + SCREEN + """) select doc_id, lang, source, n_chars, md5(text) as text_md5, not remove as kept, reason, case when remove then jac end as jac, case when remove then cos end as cos,
  case when remove then 'train:' || match_id end as match_train_id from v join documents on doc_id=id""")
def sink_split_removed(spark, d):
    """The screen's kept and removed rows, written whole; removed ones carry what they matched and how closely."""
    cands, refs = doc_sides(spark, d)
    verdict = nd.screen(cands, refs, vec.knn(*vec_sides(spark, d), 10)).withColumnRenamed("id", "doc_id")
    judged = docs(spark, d).filter("doc_id % 2 = 1")  # the candidates: other rows have no verdict and need not move
    path = r.write_verdicts(judged.join(verdict, "doc_id"), r.scratch(spark, "verdicts"), "train:")
    kept, removed = r.read_verdicts(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    cols = ["doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5")]
    dedup = [F.col(f"_dedup.{x}").alias(x) for x in ("reason", "jac", "cos", "match_train_id")]
    return kept.select(*cols, F.lit(True).alias("kept"), *dedup).unionByName(removed.select(*cols, F.lit(False).alias("kept"), *dedup))


# New rows against the benchmark: roles swapped. Vector 2i + 1 stands for benchmark item i, even vectors for the documents.
ITEM_KNN = """dots as (select a.vec_id as id, (b.vec_id-1)//2 as match_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]),9) as cos from embeddings a join embeddings b on a.vec_id%2=0 and b.vec_id%2=1 and (b.vec_id-1)//2 in (select item_id from benchmark)),
  nn as (select * from (select *, row_number() over (partition by id order by cos desc, match_id) as place from dots) where place<=10)"""


@query("screen_candidates", "with " + ITEM_KNN + f""", gs as (select doc_id, unnest({shingles('x')}) as g from (select doc_id, {norm_neardup('text')} as x from documents)),
  gb as (select item_id, unnest({shingles('x')}) as g from (select item_id, {norm_neardup('text')} as x from benchmark)),
  {minhash_ctes('gs', 'doc_id', 'ma')}, {minhash_ctes('gb', 'item_id', 'mb')},
  cand as (select distinct a.id, b.id as match_id from ma_bands a join mb_bands b using (band, b) union select id, match_id from nn where id in (select doc_id from documents)),
  sa as (select doc_id, count(*) as n from gs group by 1), sb as (select item_id, count(*) as n from gb group by 1),
  pj as (select doc_id as id, item_id as match_id, count(*) as c from gs join gb using (g) group by 1,2),
  jj as (select cand.id, cand.match_id, coalesce(c*1e0/(sa.n+sb.n-c), 0e0) as jac from cand left join pj using (id, match_id) left join sa on sa.doc_id=cand.id left join sb on sb.item_id=cand.match_id),
  bj as (select id, arg_max(match_id, (jac, -match_id)) as jm, max(jac) as jac from jj group by 1),
  sv as (select d.doc_id as id, d.source, n.cos, n.match_id as cm, coalesce(bj.jac,0e0) as jac, bj.jm from documents d left join (select * from nn where place=1) n on n.id=d.doc_id left join bj on bj.id=d.doc_id)
  select id, source, {VERDICT_SQL} from sv""")
def screen_candidates(spark, d):
    new = docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "benchmark")
    ref = items.select(F.col("item_id").alias("id"), "text")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    item_vectors = vectors.filter("id % 2 = 1").select(F.shiftright(F.col("id") - 1, 1).alias("id"), "vec").join(items.select(F.col("item_id").alias("id")), "id", "left_semi")
    verdict = nd.screen(new, ref, vec.knn(vectors.filter("id % 2 = 0"), item_vectors, 10))
    return verdict.join(docs(spark, d).select(F.col("doc_id").alias("id"), "source"), "id")


# How this query words a goal; a caller of the operator passes a list of its own.
WORDINGS = {"question": "Would it be possible to {goal} as well?", "list": "- {goal}\n- report when it is done", "aside": "({goal})", "quote": "A visitor once wrote: \"{goal}\"."}
FORMS_SQL = " union all ".join(f"select {n % v.GOAL_GROUPS} as grp, '{family}' as goal_family, {q(w.replace('{goal}', g))} as payload" for n, g in enumerate(v.GOALS) for family, w in WORDINGS.items())


@query("attack_cross", f"""with l as (select distinct source as suite, unnest(string_split(replace({PLAIN_SQL}, '. ', '. {{injection_' || lang || '}} '), chr(10))) as carrier from documents),
  c0 as (select suite, carrier, regexp_extract(carrier, '\\{{([A-Za-z0-9_]*injection[A-Za-z0-9_]*)\\}}', 1) as vector from l where contains(carrier, '{{injection_')), f as ({FORMS_SQL}),
  t as (select suite, vector, goal_family, {strip("substr(carrier, 1, instr(carrier, '{injection_')-1) || payload || replace(substr(carrier, instr(carrier, '{injection_')+length(vector)+2), '{' || vector || '}', '<' || vector || '>')")} as text
    from c0 join f on grp = ('0x' || substr(md5(coalesce(suite, '')), 1, 8))::bigint % {v.GOAL_GROUPS})
  select suite, min(vector) as vector, min(goal_family) as goal_family, 'tool' as channel, text from t where text<>'' group by suite, text""")
def attack_cross(spark, d):
    """Every carrier of all documents with every goal of its suite in every wording: records of text and provenance."""
    plain = F.replace(t.without_slots(F.col("text")), F.lit(". "), F.concat(F.lit(". {injection_"), F.col("lang"), F.lit("} ")))
    lines = docs(spark, d).select(F.col("source").alias("suite"), F.explode(F.split(plain, "\n")).alias("carrier"))
    carriers = lines.filter(F.col("carrier").rlike(t.SLOT)).distinct().withColumn("vector", F.regexp_extract("carrier", t.SLOT, 1))
    return c.attack_cross(carriers, v.GOALS, WORDINGS, v.GOAL_GROUPS)


@query("vocab_coverage", with_(planted_cte(), f"tg as (select doc_id, side, unnest({shingles('x', 5, False)}) as g from (select doc_id, side, {squeeze('right(text,80)')} as x from planted))",
                               "vc as (select distinct g from tg where side='train')") + """ select p.doc_id, round(coalesce(s.cov,0e0),6) as coverage from planted p left join
  (select doc_id, count(vc.g)*1e0/count(*) as cov from tg left join vc using (g) where side='eval' group by 1) s using (doc_id) where p.side='eval'""")
def vocab_coverage(spark, d):
    x = planted(spark, d).select("doc_id", "side", "text")
    return rnd(ov.coverage(x.filter("side = 'eval'"), x.filter("side = 'train'"), "doc_id", "text"), "coverage")


COVER = """cv as (select source, cov from (select p.doc_id, p.source, coalesce(s.cov,0e0) as cov from planted p left join
  (select doc_id, count(vc.g)*1e0/count(*) as cov from tg left join vc using (g) where side='eval' group by 1) s using (doc_id) where p.side='eval')),
  rk as (select source, cov, row_number() over (partition by source order by cov)-1 as i, count(*) over (partition by source) as n from cv)"""


@query("coverage_summary", with_(planted_cte(), f"tg as (select doc_id, side, unnest({shingles('x', 5, False)}) as g from (select doc_id, side, {squeeze('right(text,80)')} as x from planted))",
                                 "vc as (select distinct g from tg where side='train')", COVER) + """ select source, count(*)::bigint as n, round(avg(cov),4) as mean, round(max(case when i=n//2 then cov end),4) as median, round(max(case when i=n//10 then cov end),4) as p10,
  round(max(case when i=(9*n)//10 then cov end),4) as p90, round(avg(case when cov>=0.999 then 1e0 else 0 end),4) as fully, round(avg(case when cov>=0.9 then 1e0 else 0 end),4) as above_09 from rk group by 1""")
def coverage_summary(spark, d):
    x = planted(spark, d).select("doc_id", "source", "side", "text")
    cov = ov.coverage(x.filter("side = 'eval'"), x.filter("side = 'train'"), "doc_id", "text", ["source"])
    return ov.coverage_summary(cov, "source")


@query("marker_distribution", with_(planted_cte()) + f" select side, {MARKER_SQL} as marker, count(*)::bigint as n from planted group by 1,2")
def marker_distribution(spark, d):
    return planted(spark, d).groupBy("side", t.marker_of(F.col("text")).alias("marker")).agg(F.count(F.lit(1)).alias("n"))


PHRASES = [*v.GOALS, "the", "und"]


@query("containment_count", with_(CORPUS) + f"""select phrase, sum(case when label=0 then (length(text)-length(replace(text,phrase,'')))//length(phrase) else 0 end)::bigint as in_safe,
  sum(case when label=1 then (length(text)-length(replace(text,phrase,'')))//length(phrase) else 0 end)::bigint as in_unsafe from corpus, (select unnest({PHRASES!r}) as phrase) group by 1""")
def containment_count(spark, d):
    return ov.containment(corpus(spark, d), "text", spark.createDataFrame([(p,) for p in PHRASES], "phrase string"))


WORDS_SQL = "(select distinct unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) as phrase from benchmark)"


@query("phrase_counts", f"""select phrase, source as key, sum((length(text)-length(replace(text,phrase,'')))//length(phrase))::bigint as n
  from documents, {WORDS_SQL} where contains(text, phrase) group by 1,2""")
def phrase_counts(spark, d):
    """Where the words of the benchmark occur, by source; the phrase list is a table that grows with the benchmark."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("phrase"))
    return ph.occurrences_by(table(spark, d, "documents"), "text", "source", words)


@query("phrase_suffix", """with ph as (select distinct unnest([right(text, 2), right(text, 4), right(text, 7)]) as phrase from conversations),
  hit as (select doc_id, phrase, row_number() over (partition by doc_id order by length(phrase) desc) as i from documents join ph on right(text, length(phrase)) = phrase and length(phrase) > 0)
  select d.doc_id, phrase as payload from documents d left join hit on hit.doc_id = d.doc_id and i = 1""")
def phrase_suffix(spark, d):
    """The longest end of a turn that is also the end of a document."""
    ends = table(spark, d, "conversations").select(F.explode(F.array(*[F.right("text", F.lit(k)) for k in (2, 4, 7)])).alias("phrase"))
    return ph.longest_suffix(table(spark, d, "documents"), "doc_id", "text", ends)


@query("set_overlap", with_(planted_cte(), f"""pt as (select side, 'payload' as kind, {PAYLOAD_SQL} as item from planted union all select side, 'carrier', {CARRIER_SQL} from planted union all select side, 'full', text from planted),
  e as (select kind, item, count(*) as c from pt where side='eval' and item is not null group by 1,2), r as (select distinct kind, item from pt where side='train' and item is not null)""") + """
  select kind, count(*)::bigint as eval_distinct, (select count(*) from r where r.kind=e.kind)::bigint as train_distinct, count(r.item)::bigint as shared, (count(*)-count(r.item))::bigint as eval_only,
  round(sum(case when r.item is not null then c else 0 end)*1e0/sum(c),4) as frac_seen from e left join r using (kind, item) group by 1""")
def set_overlap(spark, d):
    x = F.col("text")
    kinds = F.array(F.struct(F.lit("payload").alias("kind"), t.payload_of(x).alias("item")), F.struct(F.lit("carrier").alias("kind"), t.carrier_of(x).alias("item")),
                    F.struct(F.lit("full").alias("kind"), x.alias("item")))
    items = planted(spark, d).select("side", F.explode(kinds).alias("k")).select("side", "k.kind", F.md5(F.col("k.item").cast("binary")).alias("item")).filter(F.col("item").isNotNull())
    return ov.set_overlap(items)


@query("union_corpora", with_(CORPUS) + "select row_id, label, source, 'base' as part from corpus union all select doc_id, 0, source, 'added' from documents where length(text) between 1000 and 5000 and doc_id not in (select row_id from corpus)")
def union_corpora(spark, d):
    base = corpus(spark, d)
    extra = docs(spark, d).filter(F.length("text").between(1000, 5000)).join(base.select(F.col("row_id").alias("doc_id")), "doc_id", "left_anti")
    added = extra.select(F.col("doc_id").alias("row_id"), F.lit(0).cast("long").alias("label"), "source", F.lit("added").alias("part"))
    return base.select("row_id", "label", "source", F.lit("base").alias("part")).unionByName(added)
