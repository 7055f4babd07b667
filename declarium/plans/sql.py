"""The core queries in SQL that DuckDB runs over the same tables, to check them by."""

from __future__ import annotations

import sys

from declarium.functions import columns
from declarium.sources import projection

ONE = """WITH one AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY project, ordinal ORDER BY ingested_at DESC) AS rn FROM items WHERE project IS NOT NULL AND ordinal IS NOT NULL) WHERE rn = 1),
ps AS (SELECT *, coalesce(signature.params, []) AS params, coalesce(signature.returns.norm_type, 'any') AS ret FROM one),
calls AS (SELECT project, ordinal, address AS caller, i - 1 AS pos, deps.calls[i] AS callee FROM one, (SELECT unnest(generate_series(1, 400)) AS i) WHERE i <= len(deps.calls) AND deps.calls[i] IS NOT NULL),
ctx AS (SELECT project, ordinal, address, 'requires' AS side, unnest(map_keys(ctx_adapter.requires)) AS key, unnest(map_values(ctx_adapter.requires)) AS type FROM one
 UNION ALL SELECT project, ordinal, address, 'provides', unnest(map_keys(ctx_adapter.provides)), unnest(map_values(ctx_adapter.provides)) FROM one),
given AS (SELECT DISTINCT project, key FROM ctx WHERE side = 'provides'), needed AS (SELECT DISTINCT project, key FROM ctx WHERE side = 'requires')
"""
_SHOW = "SELECT project, ordinal, address, name, sig_class FROM one"
_ENTRY = "(coalesce(name IN ('main', '__init__', '__main__', 'setup') OR starts_with(name, 'cmd_') OR starts_with(name, 'test_') OR starts_with(name, 'handle_'), false) OR coalesce(contains(lower(file), 'test'), false) OR coalesce(kind = 'script_main', false))"
_SIG = "'sig:' || coalesce(array_to_string(list_transform(list_filter(params, lambda p: coalesce(p.kind, 'positional') NOT IN ('receiver', 'kwvariadic')), lambda p: CASE WHEN p.kind = 'variadic' THEN '*' ELSE '' END || coalesce(p.norm_type, 'any')), ','), '') || '->' || ret"
_UNTYPED = "len(list_filter(params, lambda p: contains(coalesce(p.norm_type, 'any'), 'any'))) + contains(ret, 'any')::INT"
_SLOTS = f", slots AS (SELECT project, ordinal, file, len(params) + 1 AS slots, {_UNTYPED} AS untyped FROM ps)"
_FILES = _SLOTS + """, files AS (SELECT project, file, sum(untyped) AS untyped, sum(slots) AS slots, min(ordinal) AS first FROM slots GROUP BY ALL),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY untyped DESC, first, file) AS rank FROM files) WHERE rank <= 3 AND untyped > 0)"""
_NEEDS = "coalesce(array_to_string(list_sort(map_keys(ctx_adapter.requires)), ','), '')"

QUERIES: dict[str, str] = {
    "f_params": ONE + "SELECT project, ordinal, i - 1 AS pos, params[i].name AS name, params[i].raw_type AS raw_type, params[i].norm_type AS norm_type, params[i].default_value AS default_value, params[i].kind AS kind FROM ps, (SELECT unnest(generate_series(1, 200)) AS i) WHERE i <= len(params)",
    "f11_sig_class": ONE + f"SELECT project, ordinal, {_SIG} AS computed FROM ps",
    "f14_module_parts": ONE + "SELECT DISTINCT file, array_to_string(list_transform(list_filter(string_split(regexp_replace(file, '\\.[^./]*$', ''), '/'), lambda p: p NOT IN ('', '.', '__init__')), lambda p: replace(p, '.', '_')), '/') AS module FROM one WHERE file IS NOT NULL",
    "f18_body_hash": "SELECT decl_id, 'sha256:' || substr(sha256(max(body_text)), 1, 16) AS hash FROM raw_decls WHERE decl_id IS NOT NULL GROUP BY decl_id",
    "f22_name_key": ONE + "SELECT project, ordinal, replace(lower(name), '_', '') AS name_key FROM one",
    "f23_trait": ONE + "SELECT project, ordinal, CASE state_capture WHEN 'pure' THEN 'fn' WHEN 'reads_captured' THEN 'Fn' WHEN 'reads_instance' THEN 'Fn' WHEN 'mutates_captured' THEN 'FnMut' WHEN 'mutates_instance' THEN 'FnMut' WHEN 'consumes' THEN 'FnOnce' END AS trait FROM one",
    "f21_entry_points": ONE + f"SELECT project, ordinal, address FROM one WHERE {_ENTRY}",
    "f20_name_tokens": ONE + "SELECT project, ordinal, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z][a-z]+)', ' \\1 ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([0-9]+)', ' \\1 ', 'g'), '[^A-Za-z0-9]+'), lambda w: len(w) > 1), lambda w: lower(w)))), ','), '') AS tokens FROM one",
    "show_address": ONE + ", e AS (SELECT * FROM one WHERE address = 'pkg.member.closure.digest_field.unsealDigitRebate'), l AS (SELECT * FROM one WHERE (group_path = 'pkg.member.closure.digest_field.unsealDigitRebate' OR starts_with(group_path, 'pkg.member.closure.digest_field.unsealDigitRebate.') OR starts_with(address, 'pkg.member.closure.digest_field.unsealDigitRebate.')) AND project NOT IN (SELECT project FROM e)) SELECT project, ordinal, address, name, sig_class FROM e UNION ALL SELECT project, ordinal, address, name, sig_class FROM l",
    "f32_lines": ONE + "SELECT project, ordinal, lpad(ordinal::VARCHAR, 5, ' ') || '  ' || address || '  ' || sig_class || '  [' || coalesce(language, 'null') || '/' || coalesce(kind, 'null') || '/' || coalesce(state_capture, 'null') || '→' || coalesce(CASE state_capture WHEN 'pure' THEN 'fn' WHEN 'reads_captured' THEN 'Fn' WHEN 'reads_instance' THEN 'Fn' WHEN 'mutates_captured' THEN 'FnMut' WHEN 'mutates_instance' THEN 'FnMut' WHEN 'consumes' THEN 'FnOnce' END, 'null') || ']' || CASE WHEN len(doc) > 0 THEN '  — ' || doc ELSE '' END AS line FROM one",
    "s3_schema_violations": ONE + "SELECT project, coalesce(address, '') AS subject, unnest(list_filter([CASE WHEN ordinal IS NULL THEN 'ordinal missing: null' END, CASE WHEN address IS NULL THEN 'address missing: null' END, CASE WHEN name IS NULL THEN 'name missing: null' END, CASE WHEN kind IS NULL THEN 'kind missing: null' END, CASE WHEN sig_class IS NULL THEN 'sig_class missing: null' END, CASE WHEN kind NOT IN ('function', 'method', 'closure', 'lambda', 'script_main') THEN 'kind not allowed: ' || kind END, CASE WHEN state_capture NOT IN ('pure', 'reads_captured', 'mutates_captured', 'consumes', 'reads_instance', 'mutates_instance') THEN 'state_capture not allowed: ' || state_capture END], lambda m: m IS NOT NULL)) AS message FROM one",
    "show_ordinals": ONE + _SHOW + " WHERE ordinal BETWEEN 3 AND 9 OR ordinal = 12",
    "show_group": ONE + _SHOW + " WHERE group_path = 'src' OR starts_with(group_path, 'src.')",
    "show_prefix": ONE + _SHOW + " WHERE group_path = 'tests' OR starts_with(group_path, 'tests.') OR starts_with(address, 'tests.')",
    "show_attributes": ONE + _SHOW + " WHERE language = 'python' AND state_capture = 'pure' AND sig_class = 'sig:any->any'",
    "show_glob": ONE + _SHOW + " WHERE regexp_full_match(name, 're[a-z]*_.*')",
    "show_project": ONE + _SHOW + " WHERE project = 'harrowgate' AND kind IN ('function', 'method')",
    "o2_search": ONE + ", s AS (SELECT CASE WHEN lower(name) = 'ledger' THEN 3 WHEN contains(lower(name), 'ledger') THEN 2 WHEN contains(lower(address), 'ledger') OR contains(lower(coalesce(doc, '')), 'ledger') THEN 1 ELSE 0 END AS score, project, ordinal, address, name FROM one) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, project, address, ordinal LIMIT 25",
    "g6_forward_deps": ONE + "SELECT project, caller, pos, callee, starts_with(callee, 'external:') AS is_external FROM calls",
    "j2_reverse_deps": ONE + "SELECT DISTINCT c.project, c.callee AS address, c.caller, c.ordinal AS caller_ordinal FROM calls c JOIN one o ON c.project = o.project AND c.callee = o.address WHERE NOT starts_with(callee, 'external:')",
    "a8_callers": ONE + "SELECT project, callee, count(DISTINCT caller) AS callers FROM calls WHERE NOT starts_with(callee, 'external:') GROUP BY ALL",
    "a1_signature_classes": ONE + """, m AS (SELECT project, sig_class, string_agg(ordinal, ',' ORDER BY ordinal) AS members FROM one WHERE sig_class IS NOT NULL GROUP BY ALL),
 x AS (SELECT DISTINCT sig_class, regexp_replace(substr(sig_class, 5), '^(.*)->.*$', '\\1') AS x FROM m), c AS (SELECT sig_class, x, unnest(generate_series(1, len(x))) AS i FROM x),
 p AS (SELECT sig_class, string_agg(CASE WHEN substr(x, i, 1) = ',' AND len(replace(substr(x, 1, i), '<', '')) = len(replace(substr(x, 1, i), '>', '')) THEN ';' ELSE substr(x, i, 1) END, '' ORDER BY i) AS params FROM c GROUP BY ALL)
 SELECT m.project, m.sig_class, coalesce(p.params, '') AS params, regexp_extract(m.sig_class, '^.*->(.*)$', 1) AS returns, m.members FROM m LEFT JOIN p USING (sig_class)""",
    "a2_op_arrays": ONE + "SELECT project, group_path AS path, sig_class, string_agg(ordinal, ',' ORDER BY ordinal) AS ordinals FROM one WHERE group_path IS NOT NULL AND sig_class IS NOT NULL GROUP BY ALL",
    "a10_summary": ONE + "SELECT o.project, count(*) AS items, count(DISTINCT sig_class) AS classes, coalesce(any_value(k.n), 0) AS ctx_keys, coalesce(array_to_string(list_sort(list(DISTINCT language) FILTER (language IS NOT NULL)), ','), '') AS languages FROM one o LEFT JOIN (SELECT project, count(DISTINCT key) AS n FROM ctx GROUP BY ALL) k ON k.project = o.project GROUP BY o.project",
    "a4_typing_health": ONE + _FILES + ", w AS (SELECT project, string_agg(coalesce(file, '') || ' (' || untyped || '/' || slots || ')', '; ' ORDER BY rank) AS worst_files FROM worst GROUP BY ALL) SELECT s.project, count(*) AS items, sum(slots)::BIGINT AS type_slots, sum(untyped)::BIGINT AS untyped, round_even(sum(untyped) * 100.0::DOUBLE / sum(slots), 1) AS untyped_pct, coalesce(any_value(worst_files), '') AS worst_files FROM slots s LEFT JOIN w ON s.project = w.project GROUP BY ALL",
    "a5_worst_files": ONE + _FILES + " SELECT project, rank::INT AS rank, file, untyped::BIGINT AS untyped, slots::BIGINT AS slots FROM worst",
    "a6_duplicates": ONE + """, k AS (SELECT sig_class, replace(lower(name), '_', '') AS name_key, project, ordinal, address FROM one WHERE kind IN ('function', 'method') AND sig_class IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY sig_class, name_key ORDER BY project, ordinal) AS rn FROM k)
 SELECT sig_class, name_key, count(*) AS items, array_to_string(list_sort(list(DISTINCT project)), ', ') AS projects, string_agg(project || ':' || address, '; ' ORDER BY rn) FILTER (rn <= 4) AS addresses FROM r GROUP BY ALL HAVING count(DISTINCT project) >= 2""",
    "a9_packages": ONE + "SELECT DISTINCT project, unnest(deps.external_packages) AS package FROM one",
    "g1_groups": ONE + """, b AS (SELECT project, ordinal, string_split(group_path, '.') AS parts, len(list_filter(string_split(regexp_replace(file, '\\.[^./]*$', ''), '/'), lambda p: p NOT IN ('', '.', '__init__'))) AS depth FROM one WHERE group_path IS NOT NULL AND group_path <> ''),
 s AS (SELECT project, ordinal, depth, parts, unnest(generate_series(1, len(parts))) AS n FROM b),
 r AS (SELECT project, ordinal, n, array_to_string(parts[1:n], '.') AS path, CASE WHEN n < depth THEN 'package' WHEN n = depth THEN 'module' ELSE 'class' END AS kind, (n = len(parts))::INT AS own FROM s)
 SELECT project, path, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\\.[^.]*$', '') ELSE '' END AS parent_path, list_last(string_split(path, '.')) AS name, arg_min(kind, ordinal * 1000 + n) AS kind, sum(own)::BIGINT AS members FROM r GROUP BY project, path""",
    "j3_dead_items": ONE + f""", tied AS (SELECT DISTINCT c.project, c.ordinal FROM ctx c JOIN needed n USING (project, key) WHERE side = 'provides' UNION SELECT DISTINCT c.project, c.ordinal FROM ctx c JOIN given g USING (project, key) WHERE side = 'requires')
 SELECT project, ordinal, address, name FROM one o WHERE NOT {_ENTRY} AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.project = o.project AND c.callee = o.address AND NOT starts_with(c.callee, 'external:')) AND NOT EXISTS (SELECT 1 FROM tied t WHERE t.project = o.project AND t.ordinal = o.ordinal)""",
    "j5_unprovided_keys": ONE + "SELECT project, key, min(ordinal) AS ordinal, arg_min(address, ordinal) AS address, CASE WHEN ends_with(key, '_result') THEN 'high' ELSE 'low' END AS severity FROM ctx c WHERE side = 'requires' AND NOT EXISTS (SELECT 1 FROM given g WHERE g.project = c.project AND g.key = c.key) GROUP BY project, key",
    "j6_unresolvable_calls": ONE + """, known AS (SELECT DISTINCT project, split_part(split_part(i, '.', 1), '/', 1) AS call FROM (SELECT project, unnest(deps.imports) AS i FROM one) WHERE i IS NOT NULL UNION SELECT DISTINCT project, unnest(deps.external_packages) FROM one)
 SELECT DISTINCT project, ordinal, caller AS address, substr(callee, 10) AS call FROM calls c WHERE starts_with(callee, 'external:') AND NOT contains(substr(callee, 10), '.') AND substr(callee, 10) NOT IN ({builtins}) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.project = c.project AND k.call = substr(callee, 10))""",
    "a7_duplicate_buckets": ONE + f"SELECT project, sig_class, {_NEEDS} AS needs, count(*) AS items FROM one GROUP BY ALL HAVING count(*) >= 2",
    "v4_wrong_classes": ONE + f"SELECT project, address AS subject, 'declared ' || coalesce(sig_class, 'none') || ', actual ' || ({_SIG}) AS message FROM ps WHERE sig_class IS DISTINCT FROM ({_SIG})",
    "v5_untyped": ONE + "SELECT project, address AS subject, 'untyped (''any'') in ' || array_to_string(list_concat(list_transform(list_filter(params, lambda p: contains(coalesce(p.norm_type, 'any'), 'any')), lambda p: coalesce(p.name, '')), CASE WHEN contains(ret, 'any') THEN ['<return>'] ELSE [] END), ', ') AS message FROM ps WHERE len(list_filter(params, lambda p: contains(coalesce(p.norm_type, 'any'), 'any'))) > 0 OR contains(ret, 'any')",
    "v11_context_conflicts": ONE + ", s AS (SELECT project, key, arg_min(type, (ordinal, side)) AS declared FROM ctx GROUP BY ALL) SELECT DISTINCT project, address || ':' || key AS subject, 'ctx key type conflict: schema ' || declared || ', item ' || coalesce(type, 'none') AS message FROM ctx JOIN s USING (project, key) WHERE declared IS DISTINCT FROM type",
    "a15_levels": ONE + f"SELECT project, level, count(*) AS n FROM (SELECT project, 'error' AS level FROM ps WHERE sig_class IS DISTINCT FROM ({_SIG}) UNION ALL SELECT project, 'warning' FROM ps WHERE len(list_filter(params, lambda p: contains(coalesce(p.norm_type, 'any'), 'any'))) > 0 OR contains(ret, 'any')) GROUP BY ALL",
}
QUERIES["p10_gaps"] = f"""SELECT project, 'dead_item' AS kind, 'medium' AS severity, address, ordinal, name || ': no in-index caller and no context edge' AS detail FROM ({QUERIES['j3_dead_items']})
 UNION ALL SELECT project, 'unresolvable_call', 'medium', address, ordinal, call FROM ({QUERIES['j6_unresolvable_calls']})
 UNION ALL SELECT project, 'unprovided_ctx_key', severity, address, ordinal, key FROM ({QUERIES['j5_unprovided_keys']}) WHERE severity = 'high'"""
QUERIES["g2_walk"] = "SELECT * FROM (" + QUERIES["g1_groups"] + ") WHERE path = 'src' OR starts_with(path, 'src.')"
_COMPACT = ONE + """, new AS (SELECT *, (row_number() OVER (PARTITION BY project ORDER BY file NULLS FIRST, ordinal) - 1)::INT AS place FROM one)
"""
QUERIES["v2_duplicate_ordinals"] = _COMPACT + """, u AS (SELECT project, ordinal, address FROM one UNION SELECT project, place, address FROM new), l AS (SELECT *, lag(address) OVER (PARTITION BY project, ordinal ORDER BY address) AS before FROM u)
 SELECT project, ordinal::VARCHAR AS subject, 'duplicate ordinal ' || ordinal || ': ''' || before || ''' and ''' || address || '''' AS message FROM l WHERE before IS NOT NULL"""
QUERIES["v3_retired_ordinals"] = _COMPACT + " SELECT project, place::VARCHAR AS subject, 'ordinal ' || place || ' (''' || address || ''') is in retired_ordinals' AS message FROM new n WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.project = n.project AND o.ordinal = n.place)"
_MEMBER = "CASE WHEN n.place IS NULL THEN '''' || o.sig_class || ''' references unknown ordinal ' || o.ordinal ELSE 'member ' || o.ordinal || ' has sig_class ' || coalesce(n.sig_class, 'none') || ', not ' || o.sig_class END"
QUERIES["v6_class_members"] = _COMPACT + f" SELECT o.project, o.sig_class AS subject, {_MEMBER} AS message FROM one o LEFT JOIN new n ON n.project = o.project AND n.place = o.ordinal WHERE o.sig_class IS NOT NULL AND (n.place IS NULL OR n.sig_class IS DISTINCT FROM o.sig_class)"
QUERIES["v10_op_array_classes"] = _COMPACT + f" SELECT o.project, o.group_path AS subject, {_MEMBER} AS message FROM one o LEFT JOIN new n ON n.project = o.project AND n.place = o.ordinal WHERE o.group_path IS NOT NULL AND o.sig_class IS NOT NULL AND (n.place IS NULL OR n.sig_class IS DISTINCT FROM o.sig_class)"
QUERIES["v8_group_members"] = _COMPACT + " SELECT o.project, o.group_path AS subject, 'group ''' || o.group_path || ''' references unknown ordinal ' || o.ordinal AS message FROM one o WHERE o.group_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM new n WHERE n.project = o.project AND n.place = o.ordinal)"
QUERIES["a8_caller_sets"] = ONE + "SELECT project, callee, array_to_string(list_sort(list(DISTINCT caller)), ',') AS callers FROM calls WHERE NOT starts_with(callee, 'external:') GROUP BY ALL"
_EDGES = """, side AS (SELECT project, address, coalesce(any_value(group_path), '') AS grp, any_value(coalesce(map_keys(ctx_adapter.requires), [])) AS needs, any_value(coalesce(map_keys(ctx_adapter.provides), [])) AS gives FROM one WHERE address IS NOT NULL GROUP BY ALL),
 c AS (SELECT DISTINCT project, caller AS src, callee AS dst FROM calls WHERE NOT starts_with(callee, 'external:')),
 f AS (SELECT DISTINCT g.project, g.address AS src, n.address AS dst FROM (SELECT project, address, unnest(gives) AS key FROM side) g JOIN (SELECT project, address, unnest(needs) AS key FROM side) n USING (project, key)),
 pairs AS (SELECT project, src, dst, max(k) AS k FROM (SELECT *, 1 AS k FROM c UNION ALL SELECT *, 0 FROM f) GROUP BY ALL),
 edges AS (SELECT p.project, src, dst, round(0.5 * k + 0.4 * (CASE WHEN len(b.needs) > 0 THEN len(list_intersect(a.gives, b.needs)) / len(b.needs) ELSE 0 END) + CASE WHEN a.grp = b.grp OR starts_with(a.grp, b.grp || '.') OR starts_with(b.grp, a.grp || '.') THEN 0.1 ELSE 0 END, 4) AS confidence FROM pairs p JOIN side a ON a.project = p.project AND a.address = src JOIN side b ON b.project = p.project AND b.address = dst WHERE src <> dst)"""
QUERIES["j7_edges"] = ONE + _EDGES + " SELECT project, src, dst, confidence FROM edges WHERE confidence >= 0.4"
QUERIES["g4_sources"] = ONE + _EDGES + ", e AS (SELECT * FROM edges WHERE confidence >= 0.5), f0 AS (SELECT DISTINCT project, src AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM e d WHERE d.project = e.project AND d.dst = e.src)) SELECT * FROM f0 UNION ALL SELECT DISTINCT project, src FROM e WHERE project NOT IN (SELECT project FROM f0)"
def _walk() -> str:
    """The first 200 maximal paths of each project in the order of a depth-first walk: a level at a time, 200 beginnings of each length."""
    text = _EDGES + """, e AS (SELECT e.project, src, dst, confidence AS c, o.ordinal AS nth FROM edges e LEFT JOIN one o ON o.project = e.project AND o.address = dst WHERE confidence >= 0.5),
 f0 AS (SELECT DISTINCT project, src AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM e d WHERE d.project = e.project AND d.dst = e.src)),
 s AS (SELECT * FROM f0 UNION ALL SELECT DISTINCT project, src FROM e WHERE project NOT IN (SELECT project FROM f0)),
 w1 AS (SELECT * FROM (SELECT project, [node] AS path, NULL::DOUBLE AS confidence, false AS done, row_number() OVER (PARTITION BY project ORDER BY node) AS place FROM s) WHERE place <= 200)"""
    for n in range(2, 9):
        text += f""",
 g{n} AS (SELECT w.project, list_append(path, dst) AS path, least(coalesce(w.confidence, e.c), e.c) AS confidence, false AS done, place AS was, c, nth, dst FROM w{n - 1} w JOIN e ON e.project = w.project AND e.src = path[len(path)] WHERE NOT done AND NOT list_contains(path, dst)),
 u{n} AS (SELECT * FROM g{n} UNION ALL SELECT project, path, confidence, true, place, 0, 0, '' FROM w{n - 1} w WHERE NOT EXISTS (SELECT 1 FROM g{n} g WHERE g.project = w.project AND g.was = w.place)),
 w{n} AS (SELECT * FROM (SELECT project, path, confidence, done, row_number() OVER (PARTITION BY project ORDER BY was, c DESC, nth, dst) AS place FROM u{n}) WHERE place <= 200)"""
    return text


QUERIES["g3_paths"] = ONE + _walk() + " SELECT project, array_to_string(path, ' -> ') AS path, confidence, len(path)::INT AS stages, place::INT AS place FROM w8"
QUERIES["o4_flows"] = ONE + _walk() + " SELECT project, array_to_string(path, ' -> ') AS path, confidence, len(path)::INT AS stages, (row_number() OVER (PARTITION BY project ORDER BY confidence DESC, len(path) DESC, place))::INT AS rank FROM w8"


_DECLS = r"""WITH one AS (SELECT * EXCLUDE (rn, language, file), regexp_replace(file, '^(\./)+', '') AS file, coalesce({lang1}, {lang2}, language) AS language
 FROM (SELECT *, row_number() OVER (PARTITION BY decl_id ORDER BY extracted_at DESC) AS rn FROM raw_decls WHERE decl_id IS NOT NULL) WHERE rn = 1),
mods AS (SELECT *, list_transform(list_filter(string_split(regexp_replace(file, '\.[^./]*$', ''), '/'), lambda p: p NOT IN ('', '.', '__init__')), lambda p: replace(p, '.', '_')) AS mod FROM one),
based AS (SELECT *, CASE WHEN starts_with(name, '<') THEN array_to_string(list_concat(mod, coalesce(scope_chain, [])), '.') || '#' || start_line ELSE array_to_string(list_concat(mod, coalesce(scope_chain, []), [name]), '.') END AS base FROM mods),
addressed AS (SELECT *, CASE WHEN rn = 1 THEN base ELSE base || '~' || rn END AS address FROM (SELECT *, row_number() OVER (PARTITION BY project, base ORDER BY file, start_line, name, decl_id) AS rn FROM based)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file, start_line, name, address) - 1 AS ordinal FROM addressed)
"""
QUERIES["f13_addresses"] = _DECLS + "SELECT project, decl_id, address FROM addressed"
QUERIES["w1_ordinals"] = _DECLS + "SELECT project, address, ordinal::INT AS ordinal FROM numbered"
QUERIES["j12_sticky_ordinals"] = _DECLS + """, stored AS (SELECT project, address, ordinal, row_number() OVER (PARTITION BY project, ordinal ORDER BY ingested_at DESC) AS rn FROM items WHERE project IS NOT NULL AND ordinal IS NOT NULL),
 old AS (SELECT project, address, min(ordinal) AS ordinal FROM stored WHERE rn = 1 AND address IS NOT NULL GROUP BY ALL),
 base AS (SELECT project, max(ordinal) + 1 AS base FROM old GROUP BY ALL), k AS (SELECT a.*, o.ordinal AS kept, coalesce(b.base, 0) AS base0 FROM addressed a LEFT JOIN old o ON a.project = o.project AND a.address = o.address LEFT JOIN base b ON a.project = b.project)
 SELECT project, address, coalesce(kept, base0 + row_number() OVER (PARTITION BY project, kept IS NULL ORDER BY file, start_line, name, address) - 1)::INT AS ordinal FROM k"""
QUERIES["j1_resolved_calls"] = _DECLS + """, c AS (SELECT project, address, array_to_string(list_concat(mod, coalesce(class_chain, [])), '.') AS grp, i AS pos, calls[i] AS raw, list_last(string_split(calls[i], '.')) AS callee FROM addressed, (SELECT unnest(generate_series(1, 400)) AS i) WHERE i <= len(calls) AND calls[i] IS NOT NULL),
 names AS (SELECT project, name AS callee, address AS target FROM addressed), n AS (SELECT project, callee, count(*) AS n, min(target) AS sole FROM names GROUP BY ALL),
 near AS (SELECT c.project, c.address, c.pos, count(*) AS near, min(target) AS nearest FROM c JOIN names t ON t.project = c.project AND t.callee = c.callee AND starts_with(t.target, c.grp || '.') GROUP BY ALL),
 r AS (SELECT c.project, c.address, c.pos, CASE WHEN near = 1 THEN nearest WHEN n = 1 THEN sole ELSE 'external:' || raw END AS t FROM c LEFT JOIN n ON n.project = c.project AND n.callee = c.callee LEFT JOIN near ON near.project = c.project AND near.address = c.address AND near.pos = c.pos),
 f AS (SELECT project, address, t, min(pos) AS pos FROM r GROUP BY ALL) SELECT project, address, string_agg(t, ',' ORDER BY pos) AS calls FROM f GROUP BY ALL"""
QUERIES["f17_packages"] = _DECLS + r""", roots AS (SELECT DISTINCT project, mod[1] AS root FROM mods WHERE len(mod) > 0), i AS (SELECT project, decl_id, language, trim(unnest(imports)) AS i FROM one),
 p AS (SELECT project, decl_id, language, CASE WHEN language = 'rust' THEN split_part(i, '::', 1) WHEN language = 'go' THEN split_part(i, '/', 1) ELSE split_part(i, '.', 1) END AS root, i FROM i WHERE i <> ''),
 k AS (SELECT project, decl_id, language, root, CASE WHEN language IN ('javascript', 'typescript') THEN CASE WHEN starts_with(i, '@') THEN array_to_string(string_split(i, '/')[1:2], '/') ELSE split_part(i, '/', 1) END WHEN language IN ('go', 'bash') THEN i WHEN language = 'java' THEN CASE WHEN contains(i, '.') THEN regexp_replace(i, '\.[^.]*$', '') ELSE i END ELSE root END AS package FROM p
  WHERE NOT CASE WHEN language IN ('javascript', 'typescript') THEN starts_with(i, '.') OR starts_with(i, '/') OR starts_with(i, 'node:') WHEN language = 'python' THEN root IN ({stdlib}) WHEN language = 'go' THEN NOT contains(root, '.') WHEN language = 'rust' THEN root IN ('crate', 'self', 'super', 'std', 'core', 'alloc', 'test', 'proc_macro') WHEN language = 'java' THEN root IN ('java', 'javax', 'jdk') WHEN language = 'bash' THEN false ELSE true END)
 SELECT project, decl_id, string_agg(DISTINCT package, ',' ORDER BY package) AS packages FROM k WHERE language IN ('javascript', 'typescript', 'bash') OR NOT EXISTS (SELECT 1 FROM roots r WHERE r.project = k.project AND r.root = k.root) GROUP BY ALL"""
_ENV = {k: "list_concat(" + ", ".join("regexp_extract_all(body_text, '" + p.replace("'", "''") + "', 1)" for p in v) + ")" for k, v in ((lang, columns.env_patterns(lang)) for lang in columns.ENV_ACCESS)}
QUERIES["f16_env_vars"] = _DECLS + "SELECT decl_id, CASE WHEN body_text IS NULL THEN '' ELSE coalesce(array_to_string(list_sort(list_distinct(CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ENV.items()) + " ELSE [] END)), ','), '') END AS env_vars FROM one"


QUERIES["s5_projects"] = "SELECT name, root, index_path, last_indexed FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY root DESC NULLS LAST, index_path DESC NULLS LAST, last_indexed DESC NULLS LAST) AS rn FROM projects WHERE name IS NOT NULL) WHERE rn = 1"


def _over_parts() -> None:
    """Graph queries run over the star schema seen as a catalog: another table of items, the rest is the same."""
    tail = ONE[ONE.index("ps AS (") :].split("\n", 1)[1]
    for k in ("j2_reverse_deps", "a8_callers", "a8_caller_sets", "j7_edges", "g4_sources", "g3_paths", "o4_flows"):
        QUERIES[k] = projection.CHECK_SQL.format(r="") + tail + QUERIES[k][len(ONE) :]


_over_parts()


def queries() -> dict[str, str]:
    from declarium.operators.gaps import KNOWN_NAMES

    names = ", ".join(f"'{n}'" for n in KNOWN_NAMES)
    stdlib = ", ".join(f"'{n}'" for n in sorted(sys.stdlib_module_names))
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in columns.ALIASES.items())
    one, two = f"CASE lower(trim(language)) {case} END", f"CASE regexp_extract(file, '\\.([a-z]+)$', 1) {case} END"
    return {k: v.replace("{lang1}", one).replace("{lang2}", two).replace("{builtins}", names).replace("{stdlib}", stdlib) for k, v in QUERIES.items()}
