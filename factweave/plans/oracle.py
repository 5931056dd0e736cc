"""The same results in DuckDB's SQL, by name."""

from __future__ import annotations

from ..functions import vocab as V
from ..operators.candidates import PHRASES, RELATIONS
from ..operators.kin import CAST, DENIED, FACTS, ONCE, PARENTS
from .adapters import CAST_SQL, DRAFT_SQL, LETTER_SQL, MENTIONS, NAMES, SQL, SURFACE_SQL, TALE_SQL, _list

_in = lambda values: "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
_norm = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"
_case = lambda x, table, default: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def _issues(where: str) -> str:
    distrust = " OR ".join("contains(said, '" + x.replace("'", "''") + "')" for x in V.EXPLICIT_DISTRUST)
    opposite = " OR ".join(f"(os = '{a}' AND ns = '{b}') OR (os = '{b}' AND ns = '{a}')" for a, b in V.OPPOSITES)
    mixed = lambda p, q: f"(os IN {_in(p)} AND ns IN {_in(q)}) OR (ns IN {_in(p)} AND os IN {_in(q)})"
    # The adapters' objects are seven names, so places are cities when of one word and unknown else.
    return f"""{SQL},
c1 AS (SELECT c.*, scene_number, {_norm("subject")} AS sk, {_norm("object")} AS ok, {_norm("coalesce(evidence_text, claim_text)")} AS told,
       {_norm("evidence_text || ' ' || claim_text")} AS said, {_norm("predicate")} AS p, e.place_granularity AS g FROM claims c JOIN scenes s ON s.id = c.scene_id LEFT JOIN entities e ON e.id = c.object_entity_id),
c2 AS (SELECT *, CASE WHEN p IN ('distrust', 'distrusts') AND contains(said, 'uncomfortable') AND NOT ({distrust}) THEN 'is uncomfortable with' ELSE p END AS cp FROM c1),
c3 AS (SELECT *, CASE WHEN polarity THEN cp ELSE {_case("cp", V.NEGATED, "cp")} END AS st, ends_with(cp, ' in') OR cp = 'is from' AS loc,
       CASE WHEN g IS NOT NULL THEN g WHEN NOT contains(ok, ' ') THEN 'city' ELSE 'unknown' END AS gr FROM c2),
prs AS (SELECT n.*, o.id AS oid2, o.subject AS osub, o.predicate AS opred, o.object AS oobj, o.polarity AS opol, o.is_major_plotline AS omaj, o.cp AS ocp, o.st AS os, n.st AS ns,
        o.ok AS ook, o.gr AS ogr, o.loc AS oloc, o.told AS otold,
        CASE WHEN n.object_entity_id IS NOT NULL AND o.object_entity_id IS NOT NULL THEN n.object_entity_id = o.object_entity_id ELSE n.ok = o.ok END AS same_object
        FROM c3 n JOIN c3 o ON n.story_id = o.story_id AND o.scene_number < n.scene_number
         AND CASE WHEN n.subject_entity_id IS NOT NULL AND o.subject_entity_id IS NOT NULL THEN n.subject_entity_id = o.subject_entity_id ELSE n.sk = o.sk END
        WHERE n.status IN {_in(V.CURRENT_CHECK)} AND o.status IN {_in(V.PAST_CANON)} AND o.valid_until_scene IS NULL),
v AS (SELECT *, cp = ocp AND same_object AND polarity <> opol AS flip,
      ok <> ook AND loc AND oloc AND NOT (gr = 'unknown' AND ogr = 'unknown') AND (contains(told || ' ' || otold, ok) OR contains(told || ' ' || otold, ook)) AS placed FROM prs),
found AS (
 SELECT *, 'polarity_flip' AS k, 'Scene ' || scene_number || ' reverses an earlier fact: ''' || CASE WHEN opol THEN osub || ' ' || opred || ' ' || oobj ELSE subject || ' ' || predicate || ' ' || object END || ''' is now negated.' AS m FROM v WHERE flip
 UNION ALL SELECT *, 'exclusive_object', 'Scene ' || scene_number || ' contradicts earlier fact: ' || subject || ' ' || predicate || ' was ''' || oobj || ''', now ''' || object || '''.' FROM v
   WHERE NOT flip AND NOT placed AND cp = ocp AND ok <> ook AND (cp IN {_in(V.EXCLUSIVE)} OR ok IN {_in(V.NOBODY)} OR ook IN {_in(V.NOBODY)})
 UNION ALL SELECT *, 'predicate_opposition', 'Scene ' || scene_number || ' conflicts with an earlier claim about ' || subject || ' and ' || object || ': earlier ''' || opred || ''', now ''' || predicate || '''.' FROM v
   WHERE NOT flip AND NOT placed AND same_object AND os <> ns AND NOT (os IN {_in(V.NEGATIVE)} AND ns IN {_in(V.NEGATIVE)}) AND NOT (os IN {_in(V.POSITIVE)} AND ns IN {_in(V.POSITIVE)})
   AND ({opposite} OR {mixed(V.APPROACHING, V.AVOIDING)} OR {mixed(V.POSITIVE, V.NEGATIVE)})),
issues AS (SELECT story_id, scene_id, id AS current_claim_id, oid2 AS conflicting_claim_id, CASE WHEN is_major_plotline OR omaj THEN 'high' ELSE 'medium' END AS severity, k AS conflict_kind,
 CASE WHEN k = 'predicate_opposition' THEN 'soft_tension' ELSE 'hard_contradiction' END AS judge_classification, CASE WHEN k = 'predicate_opposition' THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS judge_confidence,
 m || CASE WHEN is_major_plotline OR omaj THEN ' This conflicts with a major plotline relationship/fact.' ELSE '' END AS message FROM found)
{where}"""


_GATED = f"""{SQL},
gated AS (SELECT c.id, c.story_id, subject_entity_id AS source, object_entity_id AS target, replace(lower(trim(predicate)), ' ', '_') AS predicate, confidence, status, scene_number,
  CASE canon_level WHEN 'core' THEN 1.2::DOUBLE WHEN 'active' THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS weight
  FROM claims c JOIN scenes s ON s.id = c.scene_id JOIN entities a ON a.id = subject_entity_id JOIN entities b ON b.id = object_entity_id
  WHERE polarity AND claim_type = 'relationship_state' AND subject_entity_id <> object_entity_id AND a.graph_eligible AND b.graph_eligible),
canon AS (SELECT *, 'active' AS shown FROM gated WHERE status IN ('approved', 'canonized'))"""


def _edges(rows: str) -> str:
    rank = "CASE WHEN predicate IN ('loves') THEN 1 WHEN predicate IN ('trusts', 'distrusts') THEN 2 WHEN predicate = 'hates' THEN 3 ELSE 6 END"
    return f"""{_GATED}, {rows},
g AS (SELECT story_id, source, target, shown, list_sort(list_distinct(list(predicate))) AS ps, min({rank}) AS r, count(*) AS n, avg(confidence) AS conf, avg(weight) AS w, sum(scene_number) AS ss, max(scene_number) AS sm FROM e GROUP BY ALL),
h AS (SELECT *, max(sm) OVER (PARTITION BY story_id) AS top, (['romantic', 'trust', 'rivalry', 'family', 'mentorship', 'social'])[r] AS prim FROM g)
SELECT story_id, source, target, CASE WHEN len(ps) = 1 THEN ps[1] ELSE prim END AS label, prim AS primary_relationship, array_to_string(ps, ',') AS sub_relationships, n AS claim_count,
 round(conf, 3) AS confidence, round((n * 0.4::DOUBLE * w + conf * 10 + ss / (top * n) * 0.3::DOUBLE)::DECIMAL(18, 6), 2)::DOUBLE AS strength, shown AS status FROM h"""


_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_HTML = "html"
for _a, _b in (
    (r"(?i)<h[123][^>]*>([\s\S]*?)</h[123]>", "\n\n## \\1\n\n"), (r"(?i)<br\s*/?>", "\n"), ("(?i)</p>", "\n\n"), ("(?i)</li>", "\n"), ("<[^>]+>", ""), ("&nbsp;", " "), ("&amp;", "&"),
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), (r"\n{3,}", "\n\n"),
):
    _HTML = f"regexp_replace({_HTML}, '{_a}', '{_b}', 'g')"
_HTML = _TRIM(_HTML)
_EXCERPT = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE {x}[1:{n - 1}] || '…' END"
_MERGE = _case("replace(lower(trim(predicate)), ' ', '_')", V.PREDICATE_ALIASES, "replace(lower(trim(predicate)), ' ', '_')")
_HASH = """CASE WHEN subject_entity_id IS NOT NULL
 THEN sha256(subject_entity_id || '|' || lower(predicate) || '|' || coalesce(object_entity_id::VARCHAR, '') || '|' || claim_type || CASE WHEN polarity THEN '' ELSE '|neg' END)
 ELSE sha256(lower(subject) || '|' || claim_type || '|' || lower(object) || CASE WHEN polarity THEN '' ELSE '|neg' END) END[1:32]"""

ORACLES: dict[str, str] = {
    "adapter_scenes": f"{SQL} SELECT * FROM scenes",
    "adapter_claims": f"{SQL} SELECT * FROM claims",
    "val_issues_all": _issues("SELECT * FROM issues"),
    "val_polarity_flip": _issues("SELECT * FROM issues WHERE conflict_kind = 'polarity_flip'"),
    "val_exclusive_object": _issues("SELECT * FROM issues WHERE conflict_kind = 'exclusive_object'"),
    "val_predicate_opposition": _issues("SELECT * FROM issues WHERE conflict_kind = 'predicate_opposition'"),
    "agg_issue_severity": _issues("SELECT conflict_kind, severity, count(*) AS n FROM issues GROUP BY ALL"),
    "gra_edges": _edges("e AS (SELECT * FROM canon)"),
    "gra_edges_preview": _edges("""e AS (SELECT * FROM canon UNION ALL SELECT * FROM (SELECT *, 'preview' FROM gated g WHERE status IN ('suggested', 'needs_review')
      AND NOT EXISTS (FROM canon c WHERE c.source = g.source AND c.target = g.target) QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY id) = 1))"""),
    "gra_nodes": f"""{_GATED},
m AS (SELECT x AS id, count(*) AS n FROM (SELECT unnest([subject_entity_id, object_entity_id]) AS x FROM claims WHERE status IN ('approved', 'canonized')) WHERE x IS NOT NULL GROUP BY 1),
d AS (SELECT x AS id, count(*) AS n FROM (SELECT unnest([source, target]) AS x FROM canon) GROUP BY 1)
SELECT e.story_id, e.id AS entity_id, canonical_name AS label, least(100.0::DOUBLE, coalesce(m.n, 0) + 5.0::DOUBLE * coalesce(d.n, 0)) AS importance_score, coalesce(m.n, 0) AS mention_count, coalesce(d.n, 0) AS relationship_degree
FROM entities e LEFT JOIN m ON m.id = e.id LEFT JOIN d ON d.id = e.id WHERE entity_type = 'character' AND (m.n > 0 OR d.n > 0)""",
    "gra_meta": f"{_GATED} SELECT story_id, count(*) AS approved_relationship_claim_count FROM canon GROUP BY 1",
    "joi_story_scene_count": f"{SQL} SELECT s.id, title, count(c.id) AS scene_count FROM stories s LEFT JOIN scenes c ON c.story_id = s.id GROUP BY ALL",
    "joi_scene_claim_count": f"{SQL} SELECT s.id, s.story_id, scene_number, count(c.id) AS claim_count FROM scenes s LEFT JOIN claims c ON c.scene_id = s.id GROUP BY ALL",
    "agg_status_counts": f"{SQL} SELECT story_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{k}') AS {k}" for k in ("approved", "canonized", "suggested", "needs_review", "rejected", "deprecated")) + " FROM claims GROUP BY 1",
    "flt_buckets": f"{SQL} SELECT scene_id, count(*) FILTER (status IN ('suggested', 'needs_review')) AS new, count(*) FILTER (status IN ('approved', 'canonized')) AS accepted, count(*) FILTER (status = 'rejected') AS rejected FROM claims GROUP BY 1",
    "agg_next_scene": f"{SQL} SELECT s.id, (coalesce(max(scene_number), 0) + 1)::BIGINT AS next_scene_number FROM stories s LEFT JOIN scenes c ON c.story_id = s.id GROUP BY 1",
    "agg_synopsis": f"""{SQL}, x AS (SELECT story_id, count(*) AS n, arg_min(text, scene_number) AS f, arg_max(text, scene_number) AS l FROM scenes GROUP BY 1)
SELECT s.id, CASE WHEN n IS NULL THEN 'A work in progress titled “' || title || '.”' WHEN n = 1 THEN '“' || title || '” opens with: ' || {_EXCERPT("f", 300)}
 ELSE '“' || title || '” follows ' || n || ' scenes. It begins: ' || {_EXCERPT("f", 220)} || ' Later threads include: ' || {_EXCERPT("l", 180)} END AS description FROM stories s LEFT JOIN x ON x.story_id = s.id""",
    "srt_new_claims": f"{SQL} SELECT scene_id, id, status, confidence, row_number() OVER (PARTITION BY scene_id ORDER BY CASE status WHEN 'needs_review' THEN 0 ELSE 1 END, confidence DESC, id) AS place FROM claims WHERE status IN ('suggested', 'needs_review')",
    "snk_markdown": f"""{SQL}, t AS (SELECT scene_id, string_agg('- ' || subject || ' | ' || predicate || ' | ' || object || CASE WHEN is_major_plotline THEN ' (major)' ELSE '' END, chr(10) ORDER BY id) AS l FROM claims GROUP BY 1),
b AS (SELECT story_id, string_agg('## Chapter ' || scene_number || chr(10) || chr(10) || text || chr(10) || chr(10) || coalesce('### Claims' || chr(10) || chr(10) || l || chr(10) || chr(10), '') || '---' || chr(10), chr(10) ORDER BY scene_number) AS b
 FROM scenes LEFT JOIN t ON t.scene_id = scenes.id GROUP BY 1)
SELECT s.id, rtrim('# ' || title || chr(10) || chr(10) || coalesce(b, ''), chr(10) || ' ') || chr(10) AS markdown FROM stories s LEFT JOIN b ON b.story_id = s.id""",
    "hsh_source": f"{SQL} SELECT id, ({_HASH.replace('END[1:32]', 'END)[1:32]')} AS source_hash FROM claims",
    "mrg_delete_replaceable": f"{SQL} SELECT id, status FROM claims WHERE status NOT IN {_in(V.REPLACEABLE)}",
    "mrg_transition": f"""{SQL}, t AS (SELECT *, {_MERGE} AS k FROM claims WHERE subject_entity_id IS NOT NULL AND object_entity_id IS NOT NULL),
u AS (SELECT *, lead(object_entity_id) OVER (PARTITION BY scene_id, subject_entity_id, k, polarity ORDER BY id) AS nxt FROM t WHERE k IN {_in(V.TRANSITIONS)})
SELECT id, scene_id, scene_id AS valid_from_scene, CASE WHEN nxt <> object_entity_id THEN scene_id END AS valid_until FROM u""",
    "mrg_stale_prune": f"{SQL} SELECT c.id, scene_id FROM claims c JOIN scenes s ON s.id = c.scene_id WHERE NOT contains(lower(text), lower(evidence_text))",
    "win_scene_dedupe": f"""{SQL}, h AS (SELECT id, scene_id, status, ({_HASH.replace('END[1:32]', 'END)[1:32]')} AS source_hash FROM claims)
SELECT * FROM h QUALIFY status = 'rejected' OR row_number() OVER (PARTITION BY scene_id, source_hash, status = 'rejected' ORDER BY CASE status WHEN 'canonized' THEN 4 WHEN 'approved' THEN 3 WHEN 'needs_review' THEN 2 WHEN 'suggested' THEN 1 ELSE 0 END DESC, id) = 1""",
    "str_scalars": f"""{SQL} SELECT id, {_norm("claim_text")} AS norm_text, trim({_norm("evidence_text")}, '"''') AS norm_evidence, replace({_norm("predicate")}, '_', ' ') AS predicate_key, {_MERGE} AS merge_key,
 CASE {" ".join(f"WHEN contains(lower(claim_text), '{x}') THEN '{'cannot_be_killed' if x == 'cannot be killed' else x}'" for x in V.INFERRED)} ELSE {_case("claim_type", V.TYPE_PREDICATE, "claim_type")} END AS inferred,
 predicate IN {_in(V.LOCATION_KEYS)} OR ends_with(predicate, ' in') OR ends_with(predicate, ' at') AS is_location, CASE WHEN contains(object, ' ') THEN 'unknown' ELSE 'city' END AS granularity,
 CASE WHEN confidence >= 0.9 THEN 'approved' WHEN confidence >= 0.65 THEN 'needs_review' ELSE 'suggested' END AS confidence_status,
 CASE WHEN predicate = 'loves' THEN 'romantic' WHEN predicate IN ('trusts', 'distrusts') THEN 'trust' WHEN predicate = 'hates' THEN 'rivalry' ELSE 'social' END AS predicate_group FROM claims""",
    "str_word_count": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+'))::BIGINT AS n_words FROM documents",
    "win_chunks": r"""WITH d AS (SELECT doc_id, trim(coalesce(text, '')) AS text, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(list_filter(generate_series(0, len(w), 1300), lambda x: x = 0 OR x + 200 < len(w))) AS s FROM d WHERE len(w) > 3000)
SELECT doc_id, 0::BIGINT AS chunk_index, len(w)::BIGINT AS n_words, text AS chunk FROM d WHERE len(w) <= 3000
UNION ALL SELECT doc_id, (s // 1300)::BIGINT, least(1500, len(w) - s)::BIGINT, array_to_string(w[s + 1 : s + 1500], ' ') FROM s""",
    "src_html_text": f"SELECT page_id, {_HTML} AS text FROM pages",
    "stm_latest_edit": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS n_edits FROM events GROUP BY 1",
}

_alt = "|".join
_NORMS = ", ".join(f"lower({c}) AS {k}" for c, k in (("subject", "s"), ("target", "t"), ("evidence", "e"), ("predicate", "p")))
_REJECT = f"""CASE WHEN s = 'narrator' OR t = 'narrator' THEN 'placeholder narrator entity' WHEN s = 'i' AND pov IS NULL THEN 'unresolved first-person without POV character'
 WHEN regexp_matches(s, '^({_alt(V.JUNK_STARTS)})\\b') THEN 'junk subject start' WHEN regexp_matches(s, '^({_alt(V.AUXILIARY_STARTS)})\\b') THEN 'auxiliary/fragment subject (Stage 0)'
 WHEN contains(s, ' way') THEN 'junk ''way'' subject' WHEN (s IN {_in(V.PRONOUNS)} OR s = 'my mom') AND p NOT IN {_in(V.KINSHIP)} THEN 'unresolved pronoun subject'
 WHEN split_part(t, ' ', 1) IN {_in(V.PRONOUNS)} AND p NOT IN {_in(V.KINSHIP)} THEN 'unresolved pronoun object (Stage 0 — no coref yet)' WHEN t IN {_in(V.JUNK_OBJECTS)} THEN 'junk object fragment'
 WHEN t = 'getting full' THEN 'incomplete gerund object' WHEN p IN {_in(V.WEAK_SPEECH)} THEN 'weak speech predicate' WHEN contains(e, 'said to me') THEN 'speech-evidence fragment' END"""
_FAMILY = _case("lower(predicate)", {v: f for f, vs in V.FAMILIES.items() for v in vs}, "lower(predicate)")
_TOLD = f"""{DRAFT_SQL}, k AS (SELECT *, lower(subject) AS s, lower(evidence) AS e, lower(target) AS t, {_FAMILY} AS f, list_filter(string_split(lower(target), ' '), lambda w: length(w) > 2) AS w FROM drafts)"""
_SAME = "a.scene_id = b.scene_id AND a.s = b.s AND (contains(a.e, b.e) OR contains(b.e, a.e) OR (a.f = b.f AND (list_has_any(a.w, b.w) OR contains(a.t, b.t) OR contains(b.t, a.t))))"
_KEY = "lower(name)"
#: Kind and confidence of `name` in the role `role`.
_KIND = rf"""CASE WHEN {_KEY} = '' THEN 'concept 0.3' WHEN {_KEY} IN {_in(V.KNOWN_PLACES)} THEN 'place 0.9' WHEN {_KEY} IN {_in(V.OBJECTS)} THEN 'object 0.88' WHEN {_KEY} IN {_in(V.ANIMALS)} THEN 'animal 0.88'
 WHEN {_KEY} IN {_in(V.CONCEPTS)} THEN 'concept 0.92' WHEN regexp_matches({_KEY}, '({_alt(V.CONCEPTS)})$') THEN 'concept 0.85' WHEN regexp_matches({_KEY}, '^(my )?({_alt(V.PARENTS)})\b') OR regexp_matches({_KEY}, '^(the )?({_alt(V.HUMAN_ROLES)})\b') THEN 'character 0.78'
 WHEN split_part({_KEY}, ' ', 1) IN ('her', 'his', 'their', 'the', 'my') AND contains(name, ' ') THEN 'concept 0.82' WHEN regexp_matches({_KEY}, '({_alt(V.PLACE_ENDS)})$') OR regexp_matches({_KEY}, '\b({_alt(V.PLACE_WORDS)})\b') THEN 'place 0.8'
 WHEN rtrim({_KEY}, 's') IN {_in(V.GROUP_WORDS)} OR {_KEY} IN {_in(V.GROUP_WORDS)} THEN 'group 0.72'
 WHEN regexp_matches(name, '^[A-Z][a-z]+( ((van|de|von|al) )?[A-Z][a-z]+)?$') OR (contains(name, ' ') AND regexp_matches(name, '^[A-Z]\S*( [A-Z]\S*)+$')) OR (NOT contains(name, ' ') AND regexp_matches(name, '^[A-Z]') AND name <> upper(name) AND {_KEY} NOT IN {_in(V.NEVER_NAMES)}) THEN 'character 0.85'
 WHEN NOT contains(name, ' ') AND role = 'object' AND regexp_matches(name, '[A-Za-z]') THEN 'concept 0.7' WHEN {_KEY} IN ('river', 'sea', 'forest') THEN 'character 0.55' WHEN NOT contains(name, ' ') THEN 'object 0.55' ELSE 'character 0.45' END"""
_ASCII = r"regexp_replace(coalesce(text, ''), '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}\p{M}]', '_', 'g')"
_WORD = r"[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?|[^\p{L}\p{N}_\s]"

ORACLES |= {
    "flt_reject_reason": f"{DRAFT_SQL}, n AS (SELECT id, pov, {_NORMS} FROM drafts) SELECT id, {_REJECT} AS reject_reason FROM n",
    "str_pov": f"""{DRAFT_SQL} SELECT id, CASE WHEN pov IS NOT NULL AND subject = 'I' THEN pov ELSE CASE WHEN pov IS NOT NULL AND subject = 'did not' THEN 'did not' ELSE subject END END AS subject,
 CASE WHEN pov IS NOT NULL AND subject = 'I' THEN pov || claim[2:] ELSE claim END AS claim FROM drafts""",
    "win_first_of_equal": f"{DRAFT_SQL} SELECT id, scene_id FROM drafts QUALIFY row_number() OVER (PARTITION BY scene_id, lower(subject), predicate, lower(target), claim_type, lower(claim)[1:120] ORDER BY ord) = 1",
    "agg_merged_sources": f"""{DRAFT_SQL}, k AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY scene_id, lower(subject), predicate, lower(target), polarity) AS n, first(id) OVER w AS g,
  CASE generation_origin WHEN 'fastus' THEN 4 WHEN 'structural' THEN 3 WHEN 'llm' THEN 2 ELSE 1 END AS o FROM drafts WINDOW w AS (PARTITION BY scene_id, lower(subject), predicate, lower(target), polarity ORDER BY ord)),
f AS (SELECT scene_id, g, r, n, subject, predicate, target, claim_type, polarity, confidence, evidence, claim, anchored, [o] AS os, NULL::VARCHAR AS rs FROM k WHERE r = 1
 UNION ALL SELECT f.scene_id, f.g, k.r, f.n, f.subject, f.predicate, f.target, f.claim_type, f.polarity,
  CASE WHEN f.anchored AND k.anchored THEN least(1.0::DOUBLE, (f.confidence + k.confidence) / 2 + 0.05::DOUBLE) ELSE greatest(f.confidence, k.confidence) END,
  CASE WHEN CASE WHEN f.anchored <> k.anchored THEN f.anchored ELSE list_max(f.os) >= k.o END THEN f.evidence ELSE k.evidence END,
  CASE WHEN length(f.claim) >= length(k.claim) THEN f.claim ELSE k.claim END, f.anchored OR k.anchored, list_distinct(f.os || [k.o]),
  CASE WHEN (f.anchored OR k.anchored) AND CASE WHEN f.anchored AND k.anchored THEN least(1.0::DOUBLE, (f.confidence + k.confidence) / 2 + 0.05::DOUBLE) ELSE greatest(f.confidence, k.confidence) END >= 0.9::DOUBLE THEN 'suggested' ELSE 'needs_review' END
  FROM f JOIN k ON k.g = f.g AND k.r = f.r + 1)
SELECT scene_id, n AS n_sources, subject, predicate, target, claim_type, polarity, confidence, evidence, claim, anchored, rs AS review_status,
 array_to_string(list_transform(list_reverse_sort(os), lambda x: (['llm_recall', 'llm', 'structural', 'fastus'])[x]), '+') AS generation_origin FROM f WHERE r = n""",
    "joi_redundant_model": f"{_TOLD} SELECT id FROM k a WHERE generation_origin = 'llm' AND EXISTS (FROM k b WHERE b.generation_origin = 'structural' AND {_SAME})",
    "joi_redundant_structural": f"{_TOLD} SELECT id FROM k a WHERE NOT (generation_origin = 'structural' AND f IN {_in(V.FAMILIES)} AND EXISTS (FROM k b WHERE b.generation_origin = 'llm' AND {_SAME}))",
    "cnd_names": rf"""WITH m AS (SELECT doc_id, regexp_extract_all({_ASCII}, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b') AS l FROM documents),
p AS (SELECT doc_id, unnest(l) AS name, generate_subscripts(l, 1) AS nth FROM m), q AS (SELECT doc_id, name, min(nth) AS nth FROM p WHERE lower(name) NOT IN {_in(V.NOT_NAMES)} AND NOT regexp_matches(lower(name), '^({_alt(V.JUNK_STARTS)})\b') GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS place, name FROM q QUALIFY place < 24""",
    "txt_tokens": f"WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, len(list_filter(t, lambda w: lower(w) IN {_in(V.NEGATIONS)})) AS n_negations, len(list_distinct(t)) AS n_distinct FROM t",
    "ent_types": rf"""{SURFACE_SQL}, c AS (SELECT *, {_KIND} AS v FROM surfaces)
SELECT name, role, split_part(v, ' ', 1) AS entity_type, split_part(v, ' ', 2)::DOUBLE AS type_confidence, v LIKE 'character%' AND split_part(v, ' ', 2)::DOUBLE >= 0.55 AS graph_eligible FROM c""",
    "ent_refined_claim_type": f"""{SQL} SELECT c.id, CASE WHEN (c.predicate IN {_in(V.RELATIONAL)} OR c.claim_type = 'relationship_state') AND s.entity_type = 'character'
 THEN CASE o.entity_type WHEN 'character' THEN 'relationship_state' WHEN 'place' THEN 'place_preference' ELSE 'character_preference' END ELSE c.claim_type END AS claim_type
 FROM claims c JOIN entities s ON s.id = subject_entity_id JOIN entities o ON o.id = object_entity_id""",
    "ent_resolved_names": f"""{SQL}, m AS (SELECT id AS story_id, unnest({_list(MENTIONS)}) AS name FROM stories), k AS (SELECT *, {_norm("name")} AS key FROM m),
x AS (SELECT k.story_id, name, e.id, CASE WHEN lower(canonical_name) = key THEN 1 WHEN NOT contains(key, ' ') AND length(key) >= 3
   AND (split_part(lower(canonical_name), ' ', 1) = key OR length(key) >= 4 AND ends_with(split_part(lower(canonical_name), ' ', 1), key)) THEN 2
   WHEN contains(key, ' ') AND NOT contains(canonical_name, ' ') AND lower(canonical_name) = split_part(key, ' ', 1) THEN 3 END AS h FROM k JOIN entities e ON e.story_id = k.story_id),
b AS (SELECT story_id, name, arg_min(id, (h, id)) FILTER (h IS NOT NULL) AS entity_id, min(h) AS h FROM x GROUP BY ALL)
SELECT story_id, name, entity_id, (['name', 'given_name', 'upgrade'])[h] AS how FROM b""",
    "ext_structural": f"""{SQL} SELECT id AS doc_id, 0::BIGINT AS ord, subject, predicate, object AS target, true AS polarity, 0.58::DOUBLE AS confidence, claim_text AS evidence, 'named_stance' AS rule,
 claim_text || '.' AS claim, 'relationship_state' AS claim_type, 'soft' AS canon_level, 'structural' AS generation_origin FROM claims WHERE predicate IN ('trusts', 'distrusts', 'loves', 'hates')""",
}

_TEXTS = "t AS (SELECT scene_id, string_agg(claim_text || '.', ' ' ORDER BY id) AS text FROM claims GROUP BY 1)"
_WRITING = "WITH w AS (SELECT user_id AS doc_id, event_id AS issue_id, event_id * 37 % 5000 AS start, event_id % 60 + 1 AS length FROM events)"

ORACLES |= {
    "ext_plain": f"""{SQL} SELECT id AS doc_id, 0::BIGINT AS ord, subject, predicate, object AS target, 'relationship_state' AS claim_type, 'active' AS canon_level,
 CASE predicate WHEN 'trusts' THEN 0.9::DOUBLE ELSE 0.88::DOUBLE END AS confidence, claim_text || '.' AS claim, claim_text AS evidence, true AS polarity, 'heuristic' AS generation_origin FROM claims WHERE predicate IN ('trusts', 'distrusts')""",
    "evd_weighed": f"""{DRAFT_SQL}, x AS (SELECT id, anchored, length(evidence) < 20 AS weak, CASE WHEN NOT anchored THEN greatest(0.0::DOUBLE, confidence - 0.15::DOUBLE) WHEN length(evidence) < 20 THEN least(confidence, 0.75::DOUBLE) ELSE confidence END AS confidence FROM drafts)
SELECT id, confidence, CASE WHEN NOT anchored OR weak OR (confidence >= 0.65::DOUBLE AND confidence < 0.9::DOUBLE) THEN 'needs_review' ELSE 'suggested' END AS review_status, 'high' AS importance FROM x""",
    "evd_anchored": f"{SQL}, {_TEXTS} SELECT c.id, contains(text, evidence_text) OR (c.id % 2 = 0 AND contains(text, claim_text)) AS anchored FROM claims c JOIN t ON t.scene_id = c.scene_id",
    "evd_spans": f"""{SQL}, {_TEXTS}, q AS (SELECT c.id, c.scene_id, text, CASE WHEN contains(text, evidence_text) THEN evidence_text ELSE claim_text END AS q FROM claims c JOIN t ON t.scene_id = c.scene_id)
SELECT id, scene_id, instr(lower(text), lower(q)) - 1 AS start, length(q) AS length, substr(text, instr(lower(text), lower(q)), length(q)) AS anchor FROM q""",
    "flt_strict": f"{DRAFT_SQL} SELECT id FROM drafts WHERE anchored OR generation_origin <> 'llm_recall'",
    "mrg_canon": f"""{SQL}, k AS (SELECT *, ({_HASH.replace('END[1:32]', 'END)[1:32]')} AS h, {_MERGE} AS mk FROM claims WHERE subject_entity_id IS NOT NULL),
o AS (FROM k WHERE id % 2 = 1 AND status IN ('approved', 'canonized') AND valid_until_scene IS NULL)
SELECT n.id, coalesce(a.id, b.id) AS canon_id FROM k n LEFT JOIN (SELECT story_id, h, min(id) AS id FROM o GROUP BY ALL) a ON a.story_id = n.story_id AND a.h = n.h
 LEFT JOIN (SELECT story_id, subject_entity_id AS s, object_entity_id AS ob, mk, polarity, min(id) AS id FROM o WHERE object_entity_id IS NOT NULL GROUP BY ALL) b
 ON b.story_id = n.story_id AND b.s = n.subject_entity_id AND b.ob = n.object_entity_id AND b.mk = n.mk AND b.polarity = n.polarity WHERE n.id % 2 = 0""",
    "ui_after_edit": f"""{_WRITING}, e AS (SELECT c_custkey AS doc_id, c_custkey * 11 % 5000 AS a, c_custkey % 9 AS gone, c_custkey % 7 AS new FROM customer)
SELECT w.doc_id, issue_id, start + CASE WHEN a IS NOT NULL AND start >= a + gone THEN new - gone ELSE 0 END AS start, length FROM w LEFT JOIN e ON e.doc_id = w.doc_id WHERE a IS NULL OR NOT (start < a + gone AND start + length > a)""",
    "ui_issue_at": f"""{_WRITING}, c AS (SELECT DISTINCT doc_id, start + 5 AS "offset" FROM w)
SELECT c.doc_id, c."offset", arg_min(issue_id, (length, issue_id)) AS issue_id FROM c JOIN w ON w.doc_id = c.doc_id AND c."offset" >= start AND c."offset" < start + length GROUP BY ALL""",
    "ui_segments": f"""{_WRITING}, p AS (SELECT DISTINCT doc_id, unnest([start, start + length]) AS start FROM w), s AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS "end" FROM p)
SELECT s.doc_id, s.start, s."end", count(*) AS depth FROM s JOIN w ON w.doc_id = s.doc_id AND w.start <= s.start AND w.start + w.length >= s."end" GROUP BY ALL""",
    "ui_confidence_label": f"{SQL} SELECT id, CASE WHEN confidence >= 0.9::DOUBLE THEN '✓' WHEN confidence >= 0.65::DOUBLE THEN '○' ELSE '⚠' END || ' ' || floor(confidence * 100 + 0.5::DOUBLE)::BIGINT || '%' AS label FROM claims",
    "ui_origins": f"{DRAFT_SQL}, n AS (SELECT scene_id, generation_origin AS o, count(*) AS n FROM drafts GROUP BY ALL) SELECT scene_id, string_agg(o || ': ' || n, ', ' ORDER BY n DESC, o) AS origins FROM n GROUP BY 1",
}
ORACLES["ui_circle"] = f"""WITH nd AS ({ORACLES["gra_nodes"]}), a AS (SELECT *, 2 * pi() * (row_number() OVER (PARTITION BY story_id ORDER BY importance_score DESC, lower(label), entity_id) - 1) / count(*) OVER (PARTITION BY story_id) - pi() / 2 AS a,
  CASE WHEN count(*) OVER (PARTITION BY story_id) > 1 THEN 220.0::DOUBLE ELSE 0::DOUBLE END AS r FROM nd)
SELECT story_id, entity_id, round(r * cos(a), 2) AS x, round(r * sin(a), 2) AS y FROM a"""

# The graph with null ids looked up by name; the adapters' names are their entities' canonical ones.
_NAMED = SQL.replace("\nclaims AS (", "\ngiven AS (") + """, claims AS (SELECT g.* REPLACE (coalesce(subject_entity_id, a.id) AS subject_entity_id, coalesce(object_entity_id, b.id) AS object_entity_id) FROM given g
  LEFT JOIN entities a ON a.story_id = g.story_id AND a.canonical_name = g.subject LEFT JOIN entities b ON b.story_id = g.story_id AND b.canonical_name = g.object)"""
for _name in ("gra_edges", "gra_edges_preview", "gra_nodes", "ui_circle"):
    ORACLES[f"{_name}_named"] = ORACLES[_name].replace(SQL, _NAMED)
_PENDING = """pending AS (SELECT *, 'preview' AS shown FROM gated g WHERE status IN ('suggested', 'needs_review')
  AND NOT EXISTS (FROM canon c WHERE c.source = g.source AND c.target = g.target) QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY id) = 1)"""
ORACLES["gra_nodes_preview_named"] = ORACLES["gra_nodes"].replace(_GATED, f"{_GATED}, {_PENDING}").replace("(m.n > 0 OR d.n > 0)", "(m.n > 0 OR d.n > 0 OR e.id IN (SELECT unnest([source, target]) FROM pending))").replace(SQL, _NAMED)
ORACLES["gra_supporting_named"] = f"""{_GATED}, {_PENDING}, s AS (SELECT * FROM canon UNION ALL SELECT * FROM pending)
SELECT s.story_id, source, target, shown AS status, (row_number() OVER (PARTITION BY source, target, shown ORDER BY s.id) - 1)::INTEGER AS place, s.id AS claim_id, s.predicate, claim_text, s.confidence, scene_number
FROM s JOIN claims c ON c.id = s.id""".replace(SQL, _NAMED)
ORACLES["gra_meta_named"] = f"""{_GATED.replace(SQL, _NAMED)}, n AS (SELECT story_id, count(*) AS n FROM canon GROUP BY 1),
p AS (SELECT story_id, count(DISTINCT (source, target)) AS n FROM gated g WHERE status IN ('suggested', 'needs_review') AND NOT EXISTS (FROM canon c WHERE c.source = g.source AND c.target = g.target) GROUP BY 1)
SELECT coalesce(n.story_id, p.story_id) AS story_id, coalesce(n.n, 0) AS approved_relationship_claim_count, coalesce(p.n, 0) AS pending_preview_claim_count FROM n FULL JOIN p ON p.story_id = n.story_id"""

# Of these names the first earlier one that matches is always one that stays.
_FOLDS = f"""{CAST_SQL}, k AS (SELECT *, {_norm("canonical_name")} AS key, list_filter(string_split({_norm("canonical_name")}, ' '), lambda w: length(w) >= 3 AND NOT contains(w, '''') AND w NOT IN {_in(V.NAME_STOPWORDS)}) AS w FROM cast0),
p AS (SELECT *, w[1] AS g, len(w) = 1 AS one, (-len(w), -length(canonical_name), id) AS place FROM k WHERE key NOT IN {_in(V.PLACEHOLDERS)}),
f AS (SELECT b.story_id, b.id, a.id AS winner_id FROM p a JOIN p b ON a.story_id = b.story_id AND a.place < b.place
 AND (a.key = b.key OR ((a.one OR b.one) AND a.g = b.g) OR (b.one AND length(b.g) >= 4 AND ends_with(a.g, b.g)) OR (a.one AND length(a.g) >= 4 AND ends_with(b.g, a.g)))
 QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY a.place) = 1)"""

ORACLES |= {
    "ent_folds": f"{_FOLDS} FROM f",
    "ent_folded": f"""{_FOLDS}, a AS (SELECT id AS w, place AS o, 0 AS side, unnest([canonical_name, 'friend']) AS n, unnest([1, 2]) AS nth FROM p
 UNION ALL SELECT winner_id, p.place, 1, unnest([p.canonical_name, 'friend', p.canonical_name]), unnest([1, 2, 3]) FROM f JOIN p ON p.id = f.id),
b AS (SELECT a.w, n, side, o, nth FROM a JOIN p ON p.id = a.w WHERE {_norm("n")} <> p.key QUALIFY row_number() OVER (PARTITION BY a.w, {_norm("n")} ORDER BY side, o, nth) = 1),
c AS (SELECT w, string_agg(trim(n), ',' ORDER BY side, o, nth) AS aliases FROM b GROUP BY 1)
SELECT e.id, e.story_id, e.canonical_name, CASE WHEN e.id IN (SELECT winner_id FROM f) THEN c.aliases ELSE e.canonical_name || ',friend' END AS aliases,
 e.graph_eligible OR EXISTS (FROM f JOIN cast0 l ON l.id = f.id WHERE f.winner_id = e.id AND l.graph_eligible) AS graph_eligible
 FROM cast0 e LEFT JOIN c ON c.w = e.id WHERE e.id NOT IN (SELECT id FROM f)""",
    "ent_repointed": f"""{_FOLDS} SELECT c.id, c.story_id, a.id AS subject_entity_id, b.id AS object_entity_id, a.canonical_name AS subject, b.canonical_name AS object FROM cast_claims c
 LEFT JOIN f fa ON fa.id = c.s LEFT JOIN f fb ON fb.id = c.t JOIN cast0 a ON a.id = coalesce(fa.winner_id, c.s) JOIN cast0 b ON b.id = coalesce(fb.winner_id, c.t)""",
}


def _family() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    plain = lambda p: text(p.replace("(?iU)", "(?i)").replace("(?U)", ""))
    role = {r: "CASE " + " ".join(f"WHEN regexp_matches(text, {plain(p)}) THEN {text(n)}" for p, n in found) + " END" for r, found in CAST.items()}
    unnamed = {"mom": "Renée", "phil": "Phil", "billy": "Billy Black"}
    end = lambda n: "pov" if n == "I" else f"coalesce({n}, {text(unnamed[n])})" if n in unnamed else text(n)
    hits = lambda of, p, g: f"regexp_extract_all({of}, {text(p)}, {g})"
    parts = []
    for i, (pattern, who, none, predicate, noun) in enumerate(PARENTS):
        p = "(?i)" + pattern
        hit = f"SELECT *, unnest({hits('s', p, 0)}) AS a, unnest({hits('s', p, 1)}) AS named, generate_subscripts({hits('s', p, 0)}, 1) AS m FROM se"
        hit = f"(SELECT *, coalesce(nullif(trim(named), ''), {who}, {text(none)}) AS pa, CASE WHEN regexp_matches(s, {plain(DENIED)}) THEN ' is not the ' ELSE ' is the ' END AS v FROM ({hit}))"
        for j, (s, t, p, what) in enumerate((("pov", "pa", "daughter_of", "daughter"), ("pa", "pov", predicate, noun))):
            parts.append(f"SELECT doc_id, {i} AS rule, si, m, {j} AS part, {s} AS subject, '{p}' AS predicate, {t} AS target, v = ' is the ' AS polarity, 0.78::DOUBLE AS confidence, a[1:200] AS evidence, {s} || v || '{what} of ' || {t} || '.' AS claim, 'relationship_state' AS claim_type FROM {hit}")
    for i, (pattern, s, predicate, t, claim, kind, sure, longest) in enumerate(FACTS, len(PARENTS)):
        p = "(?is)" + pattern
        hit = f"(SELECT *, unnest({hits('text', p, 0)}) AS a, generate_subscripts({hits('text', p, 0)}, 1) AS m FROM l)"
        shown = "pov" if "I" in (s, t) else end(s)
        parts.append(f"SELECT doc_id, {i}, 0, m, 0, {end(s)}, '{predicate}', {end(t)}, true, {sure}::DOUBLE, a[1:{longest}], replace({text(claim)}, '%s', {shown}), '{kind}' FROM {hit}")
    for i, (patterns, s, predicate, t, claim, kind, sure, evidence) in enumerate(ONCE, len(PARENTS) + len(FACTS)):
        parts.append(f"SELECT doc_id, {i}, 0, 0, 0, {end(s)}, '{predicate}', {end(t)}, true, {sure}::DOUBLE, {text(evidence)}, replace({text(claim)}, '%s', {end(s)}), '{kind}' FROM l WHERE " + " AND ".join(f"regexp_matches(text, {plain(p)})" for p in patterns))
    return f"""{LETTER_SQL}, l AS (SELECT *, {", ".join(f"{v} AS {r}" for r, v in role.items())} FROM letters), se AS (SELECT *, unnest(regexp_split_to_array(text, '[.!?]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?]+'), 1) AS si FROM l),
x AS ({" UNION ALL ".join(parts)})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule, si, m, part) - 1 AS ord, subject, predicate, target, polarity, confidence, evidence, claim, claim_type, 'active' AS canon_level, 'family' AS generation_origin FROM x WHERE subject IS NOT NULL AND target IS NOT NULL"""


ORACLES["ext_family"] = _family()


_sql_pattern = lambda p: p.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")
_PIECE = "[^.!?]+(?:[.!?]+|$)"
_at = lambda gaps, found, i: f"(list_sum(list_transform({gaps}[1:{i}], lambda g: length(g))) + coalesce(list_sum(list_transform({found}[1:{i} - 1], lambda g: length(g))), 0))::BIGINT"
_TOLD = f"""{TALE_SQL}, p0 AS (SELECT *, regexp_extract_all(text, '{_PIECE}') AS m, string_split_regex(text, '{_PIECE}') AS g FROM tales),
p1 AS (SELECT doc_id, text, pov, unnest(m) AS raw, m, g, generate_subscripts(m, 1) AS i FROM p0),
se AS (SELECT doc_id, text, pov, raw, trim(raw) AS said, {_at("g", "m", "i")} AS f, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sentence_index FROM p1 WHERE trim(raw) <> '')"""


def _phrases() -> str:
    parts = []
    for kind, pattern in PHRASES.items():
        p = _sql_pattern(pattern)
        here = "trim(substring(raw, a + 1, length(w)))"
        low = kind in ("family_phrase", "state_phrase", "verb_phrase")
        shifted = kind in ("state_phrase", "verb_phrase")
        modifier = "'my'" if kind == "family_phrase" else "''" if shifted else "lower(split_part(w, ' ', 1))"
        negated = rf"regexp_matches({here}, '(?i)\b(?:not|never)\b')" if shifted else "false" if kind == "place_phrase" else f"regexp_matches(said, '{_sql_pattern(DENIED)}')"
        parts.append(f"""SELECT doc_id, sentence_index, f + a AS start, f + a + length(w) AS "end", '{kind}' AS phrase_type, {here if shifted else "w"} AS phrase, {"lower(h)" if low else "h"} AS head, {modifier} AS modifier, {negated} AS negated
 FROM (SELECT *, {_at("gs", "ws", "i")} AS a FROM (SELECT *, unnest(ws) AS w, unnest(hs) AS h, generate_subscripts(ws, 1) AS i FROM (SELECT *, regexp_extract_all(said, '{p}') AS ws, regexp_extract_all(said, '{p}', 1) AS hs, string_split_regex(said, '{p}') AS gs FROM se)))
 {f"WHERE lower(h) NOT IN {_in(V.KIN_TERMS)}" if kind == "possessive_phrase" else ""}""")
    return _TOLD + "\n" + " UNION ALL ".join(parts)


def _resolved(x: str) -> str:
    """Mentions have two words at most here."""
    bare = rf"regexp_replace(regexp_replace(trim({x}), '\s+', ' ', 'g'), '(?i)(?: (?:{_alt(V.OBJECT_FILLERS)}))+$', '')"
    head = f"lower(split_part({bare}, ' ', 1))"
    roles = " ".join(f"WHEN {head} = '{r}' AND is_{r} IS NOT NULL THEN is_{r}" for r in CAST)
    return f"CASE WHEN {head} IN {_in(V.NARRATING)} THEN nullif(coalesce(pov, ''), '') WHEN {head} IN {_in(V.THIRD_PERSON)} THEN NULL {roles} ELSE {bare} END"


def _relations(then: str) -> str:
    role = ", ".join("CASE " + " ".join(f"WHEN regexp_matches(text, '{_sql_pattern(p)}') THEN '{n}'" for p, n in of) + f" END AS is_{r}" for r, of in CAST.items())
    parts = []
    for n, (pattern, _, _, what, origin, sure) in enumerate(RELATIONS):
        p = _sql_pattern(pattern)
        same = " ".join(f"WHEN '{k}' THEN '{v}_of'" for k, v in V.KIN_SAME.items())
        predicate = {"family_rule": f"CASE lower(v) {same} ELSE replace(lower(v), '-', '_') || '_of' END", "pattern": _case("lower(v)", V.EMOTIONS, "lower(v)"), "state_rule": "lower(v)"}[origin]
        polarity = rf"NOT regexp_matches(w, '(?i)\b(?:not|never)\b')" if what else str(n != 0).lower()
        parts.append(f"""SELECT doc_id, pov, {", ".join(f"is_{r}" for r in CAST)}, sentence_index, {n} AS rule, {_at("gs", "ws", "i")} AS a, f, w, CASE WHEN coalesce(s, '') = '' THEN 'I' ELSE s END AS who, {predicate} AS predicate, {"o" if what else "'I'"} AS what, {polarity} AS polarity, '{origin}' AS origin, {sure}::DOUBLE AS confidence
 FROM (SELECT *, unnest(ws) AS w, unnest(ss) AS s, unnest(vs) AS v, unnest(os) AS o, generate_subscripts(ws, 1) AS i
  FROM (SELECT *, regexp_extract_all(said, '{p}') AS ws, regexp_extract_all(said, '{p}', 1) AS ss, regexp_extract_all(said, '{p}', 2) AS vs, regexp_extract_all(said, '{p}', {what}) AS os, string_split_regex(said, '{p}') AS gs FROM sr))""")
    return rf"""{_TOLD}, sr AS (SELECT *, {role} FROM se), x AS ({" UNION ALL ".join(parts)}),
y AS (SELECT *, {_resolved("who")} AS subject, {_resolved("what")} AS object FROM x),
z AS (SELECT doc_id, sentence_index, f + a AS start, f + a + length(w) AS "end", subject, predicate, object, polarity, confidence, w AS evidence, origin FROM y
 WHERE coalesce(subject, '') <> '' AND coalesce(object, '') <> '' AND NOT regexp_matches(lower(subject), '^({_alt(V.AUXILIARY_STARTS)})') AND split_part(lower(object), ' ', 1) NOT IN ('him', 'her', 'them', 'me', 'you', 'it')
  AND NOT regexp_matches(lower(object), ' (all|either|anymore)$') AND NOT (lower(subject) = lower(object) AND ends_with(predicate, '_of'))
 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(subject), lower(predicate), lower(object), polarity ORDER BY sentence_index, rule, a) = 1)
{then}"""


ORACLES["cnd_phrases"] = _phrases()
ORACLES["cnd_relations"] = _relations("SELECT * FROM z")
ORACLES["stm_touched_issues"] = _issues("SELECT * FROM issues WHERE scene_id IN (SELECT event_id FROM events)")
_CUT = lambda pattern: f"string_split(regexp_replace(t, '{pattern}', chr(57344) || '\\1', 'g'), chr(57344))"
ORACLES["src_scene_split"] = rf"""WITH h AS (SELECT page_id, {_HTML} AS x FROM pages), t AS (SELECT page_id AS id, {_TRIM("replace(x, chr(13) || chr(10), chr(10))")} AS t FROM h),
g AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '


+'), lambda p: {_TRIM("p")}), lambda p: length(p) >= 80) AS gaps FROM t),
p AS (SELECT id, t, CASE WHEN contains(t, chr(10) || '---' || chr(10)) THEN string_split(t, chr(10) || '---' || chr(10)) WHEN regexp_matches(t, '(?m)^##\s+') THEN {_CUT(r"(?m)^(##\s)")}
  WHEN regexp_matches(t, '(?im)^Chapter\s+\d+') THEN {_CUT(r"(?im)^(Chapter\s+\d)")} WHEN regexp_matches(t, '


+') AND len(gaps) > 1 THEN gaps END AS p FROM g),
f AS (SELECT id, t, list_filter(list_transform(p, lambda x: {_TRIM("x")}), lambda x: x <> '') AS p FROM p), w AS (SELECT id, CASE WHEN coalesce(len(p), 0) = 0 THEN [t] ELSE p END AS p FROM f)
SELECT id, unnest(generate_series(1, len(p))) AS scene_number, unnest(p) AS text FROM w"""


def _debounced(content: str, gap: int) -> str:
    """saves() over the events: the ones not followed within the gap, without those that the one before told too."""
    return f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, to_json([{content}])::VARCHAR AS content FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, content) AS next FROM e), q AS (SELECT * FROM n WHERE next IS NULL OR next >= t + {gap}),
b AS (SELECT *, lag(content) OVER (PARTITION BY user_id ORDER BY t) AS before FROM q)
SELECT user_id AS scene_id, strftime(make_timestamp((t + {gap}) * 1000), '%Y-%m-%d %H:%M:%S.%g') AS saved_at, content FROM b WHERE before IS NULL OR before <> content"""


ORACLES["stm_autosaves"] = _debounced("trim(event_type)", 86_400_000)
ORACLES["stm_checks"] = _debounced("trim(props), trim(event_type)", 21_600_000)
ORACLES["ent_resolved_claims"] = rf"""{SQL}, kinds AS (SELECT name, role, split_part({_KIND}, ' ', 1) AS kind FROM (SELECT unnest({_list(NAMES)}) AS name, unnest(['subject', 'object']) AS role UNION SELECT unnest({_list(NAMES)}), 'subject' UNION SELECT unnest({_list(NAMES)}), 'object')),
x AS (SELECT c.* REPLACE (replace(predicate, 'lives in', 'lives_in') AS predicate, s.id AS subject_entity_id, o.id AS object_entity_id), a.kind AS sk, b.kind AS ok FROM claims c
  JOIN entities s ON s.story_id = c.story_id AND s.canonical_name = subject JOIN entities o ON o.story_id = c.story_id AND o.canonical_name = object
  JOIN kinds a ON a.name = subject AND a.role = 'subject' JOIN kinds b ON b.name = object AND b.role = 'object'),
y AS (SELECT * REPLACE (CASE WHEN (predicate IN {_in(V.RELATIONAL)} OR claim_type = 'relationship_state') AND sk = 'character'
  THEN CASE ok WHEN 'character' THEN 'relationship_state' WHEN 'place' THEN 'place_preference' WHEN 'group' THEN 'character_state' ELSE 'character_preference' END ELSE claim_type END AS claim_type) FROM x)
SELECT id, subject, predicate, object, claim_type, subject_entity_id, object_entity_id,
 substr(sha256(subject_entity_id || '|' || predicate || '|' || object_entity_id || '|' || claim_type || CASE WHEN polarity THEN '' ELSE '|neg' END), 1, 32) AS source_hash, NULL::VARCHAR AS unresolved FROM y"""
ORACLES["cnd_drafts"] = _relations(rf""", kinds AS (SELECT name, {_KIND} AS v FROM (SELECT DISTINCT unnest([subject, object]) AS name, 'subject' AS role FROM z))
SELECT doc_id, start, "end", subject, p AS predicate, object AS target,
 CASE WHEN ends_with(p, '_of') THEN 'relationship_state' WHEN regexp_matches(evidence, '{_sql_pattern(V.TIME_MARKS)}') THEN 'timeline_fact'
  WHEN p IN {_in(V.FEELINGS)} THEN CASE ok WHEN 'place' THEN 'place_preference' ELSE 'character_state' END WHEN sk NOT IN ('character', 'animal', 'group') THEN 'character_state'
  WHEN ok IN ('character', 'animal', 'group') THEN 'relationship_state' WHEN ok = 'place' THEN 'place_preference' ELSE 'character_preference' END AS claim_type,
 subject || CASE WHEN ends_with(p, '_of') THEN CASE WHEN polarity THEN ' is the ' ELSE ' is not the ' END || replace(left(p, length(p) - 3), '_', '-') || ' of '
  WHEN p IN {_in(V.FEELINGS)} THEN CASE WHEN polarity THEN ' is ' ELSE ' is not ' END || p || ' with ' WHEN polarity THEN ' ' || p || ' ' ELSE ' does not ' || left(p, length(p) - 1) || ' ' END || object || '.' AS claim,
 polarity, confidence, evidence, CASE WHEN confidence >= 0.9 THEN 'approved' WHEN confidence >= 0.65 THEN 'needs_review' ELSE 'suggested' END AS status, 'fastus' AS generation_origin, 'active' AS canon_level
FROM (SELECT z.*, replace(predicate, ' ', '_') AS p, split_part(a.v, ' ', 1) AS sk, split_part(b.v, ' ', 1) AS ok FROM z JOIN kinds a ON a.name = subject JOIN kinds b ON b.name = object)""")
