"""Line deduplication by a log-template tree, in DataFrame functions alone.

A line's form is the line with single blanks and its plain variable fields masked: tokens with a digit or an at
sign, and links. The tree has a fixed depth: the token count, then the LEAD leading tokens; below that lie leaves.
A form that enough different texts hold is a template as it stands. The other forms of a leaf are generalised
into one template, position by position: a token that more than half of them (weighted by texts) show stays,
any other is a field. A form belongs to its leaf's template if it agrees with all tokens that stayed.

Templates are counted over distinct texts, so whole copies count once. A near copy of another document shares nearly all its
lines with it, which says nothing about a line; so only texts in which recurring lines make up less than SHARE of
the tokens are evidence, and a template that has enough of them is dropped wherever it stands. All
steps are sums and distinct pairs, which are aggregated before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, some, spread_join, unused

#: Variable fields, a fixed pattern: tokens with a digit or an at sign, and links. Tokens are tried at their start alone.
FIELDS = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*|https?:\S+"
VARIES = r"[0-9@]"
FIELD = "<*>"
#: Leading tokens that are levels of the tree.
LEAD = 2
#: Texts that a template needs: so many, fewer if LONG tokens of it are fixed, and one of RARE texts at least if under FEW are.
LEAST, LEAST_LONG, LONG, FEW, RARE = 5, 3, 20, 3, 200
#: Tenths of a text's tokens from which on recurring lines make it a copy, and no evidence.
SHARE = 6
#: Forms or templates that are broadcast at most; more are joined by shuffling hashes.
MOST_BROADCAST = 1 << 18


def single_blanks(line: Column) -> Column:
    uneven = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.trim(F.when(uneven, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def masked(line: Column) -> Column:
    """A line's form. The pattern only runs where it can match."""
    return F.when(line.rlike(VARIES) | F.contains(line, F.lit("http")), F.regexp_replace(line, FIELDS, FIELD)).otherwise(line)


def occurrences(text: Column, part: str) -> Column:
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def hashes(form: Column) -> list[Column]:
    return [F.xxhash64(form).alias("one"), F.xxhash64(F.lit("second"), form).alias("two")]


def place(x: Column) -> Column:
    """Of a form and its number of tokens: two hashes, its leaf, its tokens and how many of them are fixed; null for a line without tokens."""
    form, n = x["form"], x["n"]
    fields = F.when(F.contains(form, F.lit(FIELD)), occurrences(form, FIELD)).otherwise(0)
    return F.when(form != "", F.struct(*hashes(form), F.xxhash64(n, F.substring_index(form, " ", LEAD)).alias("leaf"), n.alias("n"), (n - fields).alias("fixed")))


def forms_of(text: Column) -> Column:
    # one step after the other, as a function's argument would be worked out wherever it is named
    return F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), single_blanks), masked)


def content(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("c1"), F.xxhash64(F.lit("second"), text).alias("c2"))


def lines_of(docs: DataFrame) -> DataFrame:
    """One row for each line with tokens: content (c1, c2), pos, one, two, leaf, n, fixed. Only hashes leave the scan."""
    counted = F.transform(forms_of(F.col("text")), lambda f: F.struct(f.alias("form"), (occurrences(f, " ") + 1).alias("n")))
    rows = docs.select(content(F.col("text")).alias("c"), F.posexplode(F.transform(counted, place)).alias("pos", "x"))
    return rows.where("x is not null").select("c.c1", "c.c2", "pos", "x.one", "x.two", "x.leaf", "x.n", "x.fixed")


def enough(texts: Column, fixed: Column, total: int) -> Column:
    least = F.when(fixed >= LONG, LEAST_LONG).otherwise(LEAST)
    return (texts >= least) & ((fixed >= FEW) | (texts * RARE >= total))


def generalised(docs: DataFrame, rest: DataFrame, total: int, most: int, scratch: Scratch) -> DataFrame:
    """Forms that belong to the template of their leaf: one, two, t1, t2, fixed. rest: forms that don't recur by themselves, most of them at most."""
    wide = rest.where(f"n > {LEAD}")
    crowded = scratch.write(wide.groupBy("leaf").agg(F.sum("docs").alias("weight")).where(F.col("weight") >= LEAST), "crowded", most)
    open_forms = scratch.write(wide.join(some(crowded, MOST_BROADCAST), "leaf").select("one", "two", "leaf", "n", "docs", "weight"), "open", most)
    # the tokens of the forms in question, from a scan of their own
    tokens = docs.select(F.explode(F.transform(forms_of(F.col("text")), lambda f: F.struct(*hashes(f), f.alias("form")))).alias("x"))
    tokens = tokens.select("x.one", "x.two", "x.form").join(some(open_forms, MOST_BROADCAST), ["one", "two"])
    tokens = tokens.groupBy("one", "two", "leaf", "n", "docs", "weight").agg(F.min("form").alias("form"))
    each = scratch.write(tokens.select("one", "two", "leaf", "n", "docs", "weight", F.posexplode(F.split("form", " ")).alias("at", "token")), "tokens")
    stays = each.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("shown"), F.max("weight").alias("weight")).where("shown * 2 > weight").select("leaf", "at", "token")
    fixed = stays.where(F.col("token") != FIELD).groupBy("leaf").agg(F.count(F.lit(1)).alias("fixed"))
    stays = scratch.write(stays.join(fixed, "leaf"), "stays")
    # tokens at positions that stayed must agree
    all_stay = stays.groupBy("leaf").agg(F.count(F.lit(1)).alias("positions"), F.max("fixed").alias("fixed"))
    agreed = each.join(stays.select("leaf", "at", "token"), ["leaf", "at", "token"]).groupBy("one", "two", "leaf", "n", "docs").agg(F.count(F.lit(1)).alias("agree"))
    own = scratch.write(agreed.join(all_stay, "leaf").where("agree = positions and fixed * 2 >= n"), "own", most)
    known = own.groupBy("leaf").agg(F.sum("docs").alias("texts"), F.max("fixed").alias("few")).where((F.col("texts") >= LEAST) & ((F.col("few") >= FEW) | (F.col("texts") * RARE >= total))).select("leaf")
    # LONG has no bearing here: such a template needs LEAST texts
    return own.join(known, "leaf", "left_semi").select("one", "two", F.col("leaf").alias("t1"), F.lit(None).cast("long").alias("t2"), F.least("fixed", F.lit(LONG - 1)).cast("int").alias("fixed"))


def drops(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """c1, c2 and the positions of the lines that go, for texts that lose lines."""
    lines = scratch.write(lines_of(docs), "lines")
    most = lines.count()
    texts = scratch.write(lines.groupBy("c1", "c2").agg(F.sum("n").alias("tokens")), "texts", most)
    total = texts.count()
    forms = lines.select("c1", "c2", "one", "two", "leaf", "n", "fixed").distinct().groupBy("one", "two")
    forms = scratch.write(forms.agg(F.count(F.lit(1)).alias("docs"), F.min("leaf").alias("leaf"), F.min("n").alias("n"), F.min("fixed").alias("fixed")), "forms", most)
    alone = enough(F.col("docs"), F.col("fixed"), total)
    recurs = forms.where(alone).select("one", "two", F.col("one").alias("t1"), F.col("two").alias("t2"), "fixed")
    several = forms.count()
    templates = scratch.write(recurs.unionAll(generalised(docs, forms.where(~alone), total, several, scratch)), "templates", several)
    own = lines.select("c1", "c2", "pos", "n", F.struct("one", "two").alias("form"))
    named = templates.select(F.struct("one", "two").alias("form"), "t1", "t2", "fixed")
    # a frequent template is split over tasks where templates are too many to broadcast
    found = own.join(F.broadcast(named), "form") if templates.count() <= MOST_BROADCAST else spread_join(own, named, "form", "inner")
    hits = scratch.write(found.drop("form"), "hits", most)
    copied = hits.groupBy("c1", "c2").agg(F.sum("n").alias("again")).join(texts, ["c1", "c2"]).where(F.col("again") * 10 < F.col("tokens") * SHARE).select("c1", "c2")
    evidence = hits.select("c1", "c2", "t1", "t2", "fixed").distinct().join(copied, ["c1", "c2"], "left_semi").groupBy("t1", "t2", "fixed").agg(F.count(F.lit(1)).alias("docs"))
    gone = scratch.write(evidence.where(enough(F.col("docs"), F.col("fixed"), total)).select("t1", "t2"), "gone", several)
    same = hits["t1"].eqNullSafe(gone["t1"]) & hits["t2"].eqNullSafe(gone["t2"])
    out = scratch.write(hits.join(some(gone, MOST_BROADCAST), same, "left_semi").groupBy("c1", "c2").agg(F.collect_set("pos").alias("drop")), "drops", total)
    scratch.drop("lines", "texts", "forms", "crowded", "open", "tokens", "stays", "own", "templates", "hits", "gone")
    return out


def line_dedup(docs: DataFrame, counts: bool = True) -> DataFrame:
    """docs with lines of recurring templates removed from text, and n_lines and n_dropped behind its columns.

    Lines end at line feeds; those without tokens are kept. All rows stay, also those that lose every line.
    A null text stays null and has no lines. Only text is read: a null or repeated doc_id has no effect, and rows with the
    same text lose the same lines. An empty table gives no rows. Columns named n_lines or n_dropped are
    replaced; with counts=False neither is added, and such columns stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    # the lists are never broadcast; a text's list is no longer than its lines, and a text that very many rows share is split
    key, drop = unused("content", docs), unused("drop", docs)
    found = drops(docs.where("text is not null").select("text"), scratch).select(F.struct("c1", "c2").alias(key), F.col("drop").alias(drop)).hint("merge")
    rows = spread_join(docs.select(*names, content(F.col("text")).alias(key)), found, key)
    split = F.split("text", "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains(F.col(drop), i))
    touched = F.col(drop).isNotNull() & F.col("text").isNotNull()
    text = F.when(touched, F.array_join(kept, "\n")).otherwise(F.col("text"))
    out = [text.alias("text") if c == "text" else F.col(c) for c in names]
    if counts:
        out.append(F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"))
        out.append(F.when(touched, F.size(drop)).otherwise(0).cast("long").alias("n_dropped"))
    return rows.select(*out)


#: DuckDB, for the query's columns (doc_id, n_lines, n_dropped, text).
ORACLE = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents where text is not null),
l as (select doc_id, text, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
t as (select *, regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '\S*[0-9@]\S*|https?:\S+', '<*>', 'g') as form from l),
u as (select distinct text, pos, form, len(string_split(form, ' ')) as n from t where form <> ''),
total as (select count(distinct text) as texts from u),
f as (select form, any_value(n) as n, count(distinct text) as docs, any_value(n) - (length(form) - length(replace(form, '<*>', ''))) // 3 as fixed from u group by form),
g as (select *, docs >= case when fixed >= 20 then 3 else 5 end and (fixed >= 3 or docs * 200 >= (select texts from total)) as alone from f),
r as (select form, docs, n, array_to_string(string_split(form, ' ')[1:2], ' ') as lead from g where not alone and n > 2),
w as (select n, lead, sum(docs) as weight from r group by n, lead having sum(docs) >= 5),
k as (select r.*, w.weight, unnest(string_split(form, ' ')) as token, generate_subscripts(string_split(form, ' '), 1) as idx from r join w using (n, lead)),
s as (select n, lead, idx, token from k group by n, lead, idx, token, weight having sum(docs) * 2 > weight),
sc as (select n, lead, count(*) as positions, count(*) filter (token <> '<*>') as fixed from s group by n, lead),
a as (select form, n, lead, any_value(docs) as docs, count(*) as agree from k join s using (n, lead, idx, token) group by form, n, lead),
o as (select a.*, sc.fixed from a join sc using (n, lead) where agree = positions and sc.fixed * 2 >= n),
q as (select n, lead from o group by n, lead having sum(docs) >= 5 and (any_value(fixed) >= 3 or sum(docs) * 200 >= (select texts from total))),
p as (select form, form as template, fixed from g where alone
    union all select form, chr(10) || n || ' ' || lead, least(fixed, 19) from o join q using (n, lead)),
h as (select u.text, u.pos, u.n, p.template, p.fixed from u join p using (form)),
e as (select text from (select text, sum(n) as again from h group by text) x join (select text, sum(n) as tokens from u group by text) y using (text) where again * 10 < tokens * 6),
z as (select template from (select distinct text, template, fixed from h) v join e using (text) group by template, fixed
    having count(*) >= case when fixed >= 20 then 3 else 5 end and (fixed >= 3 or count(*) * 200 >= (select texts from total))),
b as (select distinct text, pos from h join z using (template))
select t.doc_id, cast(count(*) as bigint) as n_lines, cast(count(b.pos) as bigint) as n_dropped,
  coalesce(string_agg(t.line, chr(10) order by t.pos) filter (b.pos is null), '') as text
from t left join b on t.text = b.text and t.pos = b.pos group by t.doc_id
union all select doc_id, 0, 0, null from documents where text is null
"""
