"""DuckDB SQL for the rows of the queries that SQL can express. None of it runs through the operators' methods."""

from __future__ import annotations

#: The words of a text, and those of its lower-cased form (A to Z only).
_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest vertex reachable, from links (a, b) that go both ways and vertices (id).
_REACH = """reach(id, c) as (select id, id from vertices union select r.id, l.b from reach r join links l on r.c = l.a),
components as (select id, min(c) as component_id from reach group by id)"""

MINHASH = f"""with recursive words as (select doc_id, {_WORDS.format(text=_LOWER)} as w from documents),
sets as (select doc_id, case when len(w) = 0 then []::varchar[][] when len(w) = 1 then [w]
  else list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i : i + 1])) end as s from words),
classes as (select min(doc_id) as id, list_sort(s) as s from sets where len(s) > 0 group by all),
elements as (select id, len(s) as n, unnest(s) as e from classes),
shared as (select x.id as a, y.id as b, x.n + y.n as total, count(*) as common from elements x join elements y on x.e = y.e and x.id < y.id group by all),
near as (select a, b from shared where 100 * common >= 80 * (total - common)),
links as (select a, b from near union all select b, a from near),
vertices as (select id from classes), {_REACH},
places as (select d.doc_id, len(d.s) as n_shingles, coalesce(p.component_id, d.doc_id) as component_id
  from sets d left join classes c on list_sort(d.s) = c.s left join components p on p.id = c.id)
select doc_id, n_shingles, component_id, doc_id = component_id as kept from places"""

EMBEDDING = f"""with recursive vectors as (select vec_id, embedding::double[] as v from embeddings),
good as (select vec_id as id, v, sqrt(list_dot_product(v, v)) as norm from vectors
  where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
near as (select x.id as a, y.id as b from good x join good y on x.id < y.id and len(x.v) = len(y.v)
  where list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.95),
links as (select a, b from near union all select b, a from near),
vertices as (select id from good), {_REACH}
select v.vec_id, (select count(*) from links l where l.a = v.vec_id) as n_links, coalesce(p.component_id, v.vec_id) as component_id,
  v.vec_id = coalesce(p.component_id, v.vec_id) as kept from vectors v left join components p on p.id = v.vec_id"""

SUBSTRING = f"""with words as (select doc_id, {_WORDS.format(text="text")} as w from documents),
windows as (select doc_id, unnest(generate_series(1, len(w) - 12)) as place, w from words where len(w) >= 13),
cut as (select doc_id, place, w[place : place + 12] as words from windows),
earliest as (select words, min(doc_id) as low from cut group by words),
repeats as (select doc_id, place from cut join earliest using (words) where doc_id > low),
gone as (select distinct doc_id, place + i as place from repeats, range(13) t(i)),
runs as (select doc_id, count(*) as n_removed, count(*) filter (where place - 1 <> before or before is null) as n_repeats, list(place) as places
  from (select doc_id, place, lag(place) over (partition by doc_id order by place) as before from gone) group by doc_id),
kept as (select doc_id, string_agg(word, ' ' order by place) as words
  from (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as place from words) x anti join gone using (doc_id, place) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(n_repeats, 0) as n_repeats, sha256(coalesce(words, '')) as kept_sha256
from words left join runs using (doc_id) left join kept using (doc_id)"""

WARC = """with payloads as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
last as (select html, max(page_id) as last from payloads group by html),
named as (select p.page_id, p.html, case when p.page_id < l.last then l.last end as refers_to,
  list_transform(generate_series(0, 31), lambda i: list_reduce([case when substr('0000000100100011010001010110011110001001101010111100110111101111',
    4 * (strpos('0123456789abcdef', substr(p.hex, (5 * i + j) // 4 + 1, 1)) - 1) + (5 * i + j) % 4 + 1, 1) = '1' then 1 else 0 end for j in range(5)],
    lambda a, b: 2 * a + b)) as digits from payloads p join last l using (html))
select page_id, strlen(html) as payload_bytes,
  list_aggregate(list_transform(digits, lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', d + 1, 1)), 'string_agg', '') as payload_digest,
  case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from named"""


def _pii() -> str:
    """Matches and the pieces between them give the places; checks and context as the contract and the operator's table of kinds say."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    back = f"string_split(reverse({digits}), '')"
    twice = f"list_transform({back}, lambda c, i: case when i % 2 = 1 then c::int when c::int > 4 then 2 * c::int - 9 else 2 * c::int end)"
    plain = "replace(m, ' ', '')"
    turned = f"concat(substr({plain}, 5), substr({plain}, 1, 4))"
    values = f"list_transform(string_split({turned}, ''), lambda c: case when c between '0' and '9' then c else (ascii(c) - 55)::varchar end)"
    remainder = f"list_reduce(list_transform(string_split(array_to_string({values}, ''), ''), lambda c: c::int), lambda a, b: (10 * a + b) % 97)"
    kinds = [  # name, pattern, groups of the match itself, check, score, context, bonus
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.9, "", 0),
        ("ip", r"[0-9]+(?:\.[0-9]+){3}", "len(list_filter(string_split(m, '.'), lambda x: x::hugeint > 255)) = 0", 0.6, r"\b(ip|host|server|address|adresse)\b", 0.3),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"len({digits}) between 12 and 19 and list_sum({twice}) % 10 = 0", 0.8, r"\b(card|visa|mastercard|credit|karte|carte|tarjeta)\b", 0.15),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({digits}) between 9 and 15", 0.6, r"\b(phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b", 0.3),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", f"len({plain}) between 15 and 34 and {remainder} = 1", 0.9, r"\b(iban|account|konto|compte|cuenta)\b", 0.1),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "not regexp_matches(left_of, '[0-9-]$') and not regexp_matches(right_of, '^[0-9-]')", 0.3, r"\b(ssn|social security|tax id)\b", 0.5),
    ]
    parts = []
    for k, (name, pattern, valid, score, context, bonus) in enumerate(kinds):
        near = f"case when regexp_matches(lower(substr(text, greatest(1, start - 39), least(40, start))), '{context}') then {score} + {bonus} else {score} end" if context else f"{score}"
        parts.append(f"""select doc_id, {k} as kind, '{name}' as name, start, start + length(m) as stop, case when {valid} then {near} else 0 end as score from (
  select doc_id, text, m, start, substr(text, 1, start) as left_of, substr(text, start + length(m) + 1, 1) as right_of from (
    select doc_id, text, found[i] as m, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::bigint as start
    from (select doc_id, text, regexp_extract_all(text, '{pattern}') as found, regexp_split_to_array(text, '{pattern}') as pieces from texts) x, range(1, 1 + len(found)) t(i)))""")
    count = lambda name: f"count(*) filter (where name = '{name}') as n_{name}"
    text = "concat_ws(':', name, start::bigint, stop::bigint)"
    return f"""with texts as (select doc_id, coalesce(text, '') as text from documents), spans as ({" union all ".join(parts)}),
found as (select * from spans where score >= 0.5),
counted as (select doc_id, {", ".join(count(k[0]) for k in kinds)}, string_agg({text}, ',' order by start, kind) filter (where kind < 4) as base,
  string_agg({text}, ',' order by start, kind) as spans from found group by doc_id)
select doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) as n_{k[0]}" for k in kinds)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join counted using (doc_id)"""


def _hex_group(i: int) -> str:
    return f"('0x' || substr(seed, {8 * i + 1}, 8))::bigint"


INFILL = f"""with texts as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as seed from documents),
drawn as (select *, {_hex_group(0)} % (n + 1) as c1, {_hex_group(1)} % (n + 1) as c2,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or {_hex_group(2)} % 100 >= 90 then 'plain' when {_hex_group(3)} % 100 < 20 then 'spm' else 'psm' end as form from texts),
cut as (select *, least(c1, c2) as low, greatest(c1, c2) as high from drawn),
pieces as (select *, substr(t, 1, low) as prefix, substr(t, low + 1, high - low) as middle, substr(t, high + 1) as suffix from cut)
select doc_id, n, form, case when form <> 'plain' then low end as prefix_chars, case when form <> 'plain' then high - low end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from pieces"""


def _balls(k: int = 16, rounds: int = 3) -> str:
    """Every distance is computed; centroids (c, m) are lists of whole numbers."""
    parts = [
        """w as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v, row_number() over () as r
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as (select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v as m from w order by sha256('1:' || vec_id), v limit {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} as (select r, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from w cross join c{i})")
        parts.append(f"a{i} as (select r, any_value(vec_id) as vec_id, any_value(v) as v, min(d) as d, arg_min(c, (d, c)) as c from d{i} group by r)")
        if i < rounds:
            parts.append(f"s{i} as (select c, p, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(generate_series(1, 64)) as p from a{i}) group by c, p)")
            parts.append(f"f{i} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by p) as m from s{i} group by c)")
            parts.append(f"c{i + 1} as (select c{i}.c, coalesce(f{i}.m, c{i}.m) as m from c{i} left join f{i} using (c))")
    return f"""with {", ".join(parts)}
select vec_id, a.c as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(m, ',')) as centroid_sha256 from a{rounds} a join c{rounds} using (c)"""


ORACLES = {
    "op1_minhash": MINHASH,
    "op2_embedding": EMBEDDING,
    "op7_pii": _pii(),
    "op8_warc": WARC,
    "op10_substring": SUBSTRING,
    "op12_infill": INFILL,
    "op13_balls": _balls(),
}
