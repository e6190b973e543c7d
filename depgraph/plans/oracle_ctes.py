"""Building blocks of the DuckDB oracles, as named CTEs over the driver's tables."""

from __future__ import annotations

import re

from depgraph.plans import fixture

_ALPHA, _ROUNDS, _TOL = 0.85, 30, 1e-6

_TOPIC_VALUES = ", ".join(
    f"({priority}, '{id_}', '{label}', CAST({y} AS DOUBLE), '{color}')"
    for priority, (id_, label, y, color) in enumerate(fixture.TOPICS)
)

CTES: dict[str, str] = {
    "topics": f"SELECT * FROM (VALUES {_TOPIC_VALUES}) AS t(priority, id, label, y, color)",
    # ---- declaration nodes
    "types": "SELECT name FROM declarations WHERE kind IN ('structure', 'class', 'inductive')",
    "kind_of": """SELECT seq, name, module, typeSignature,
        CASE WHEN instantiates IS NOT NULL THEN 'instance' WHEN nConstructors > 0 THEN 'inductive'
             WHEN nExtends > 0 THEN 'class' ELSE 'def' END AS kind FROM extract""",
    "attributed": """SELECT name, arg_max(module, seq) AS module, arg_max(typeSignature, seq) AS typeSignature,
        arg_min(kind, seq) AS kind FROM kind_of WHERE module IS NOT NULL GROUP BY name""",
    "legacy": """SELECT name, arg_max(typeSignature, seq) AS typeSignature FROM extract
        WHERE module IS NULL GROUP BY name""",
    "signature_of": "SELECT name, arg_max(typeSignature, seq) AS typeSignature FROM extract GROUP BY name",
    "field_rows": """SELECT DISTINCT src, dst, position FROM fields WHERE src IN (SELECT name FROM types)""",
    "constructor_rows": """SELECT DISTINCT src, dst, position FROM constructors
        WHERE src IN (SELECT name FROM types)""",
    "promoted": """SELECT m.name, CASE WHEN m.r = 1 THEN 'constructor' ELSE 'field' END AS kind,
        coalesce(s.typeSignature, '') AS typeSignature
        FROM (SELECT name, max(r) AS r FROM (SELECT dst AS name, 0 AS r FROM field_rows
              UNION ALL SELECT dst, 1 FROM constructor_rows) GROUP BY name) AS m
        LEFT JOIN signature_of s ON s.name = m.name""",
    "dep_targets": "SELECT DISTINCT dst AS name FROM deps",
    "rel_targets": """SELECT dst AS name FROM extends UNION SELECT instantiates FROM extract
        WHERE instantiates <> '' UNION SELECT replacement FROM extract WHERE replacement <> ''
        UNION SELECT additiveVersion FROM extract WHERE additiveVersion <> ''""",
    "early": """SELECT name FROM declarations UNION SELECT name FROM attributed
        UNION SELECT name FROM dep_targets""",
    "every_name": """SELECT name FROM early UNION SELECT name FROM rel_targets
        UNION SELECT name FROM promoted""",
    "nodes": """SELECT e.name, coalesce(p.kind, d.kind, a.kind) AS kind, d.shortName, d.namespace,
        d.docstring, d.sourceFile, d.startLine, d.endLine, d.sourceText, d.attr, d.isProtected,
        d.isDeprecated, strftime(d.deprecatedSince, '%Y-%m-%d') AS deprecatedSince,
        (d.name IS NULL AND p.name IS NULL) AS isExternal, a.module,
        CASE WHEN p.name IS NOT NULL THEN p.typeSignature
             ELSE coalesce(CASE WHEN y.name IS NOT NULL THEN l.typeSignature END, a.typeSignature) END
          AS typeSignature,
        CASE p.kind WHEN 'field' THEN 'Field' WHEN 'constructor' THEN 'Constructor' ELSE
          CASE d.kind WHEN 'theorem' THEN 'Theorem' WHEN 'lemma' THEN 'Lemma' WHEN 'def' THEN 'Definition'
            WHEN 'instance' THEN 'Instance' WHEN 'class' THEN 'Class' WHEN 'structure' THEN 'Structure' END
        END AS label
        FROM every_name e LEFT JOIN declarations d ON d.name = e.name
        LEFT JOIN attributed a ON a.name = e.name LEFT JOIN promoted p ON p.name = e.name
        LEFT JOIN early y ON y.name = e.name LEFT JOIN legacy l ON l.name = e.name""",
    "depends": """SELECT DISTINCT src, dst, CASE WHEN inType AND inValue THEN 'both'
        WHEN inType THEN 'type' ELSE 'value' END AS context
        FROM deps WHERE src IN (SELECT name FROM nodes)""",
    "pairs": "SELECT DISTINCT src, dst FROM depends",
    "busiest": """SELECT dst AS name FROM depends WHERE dst IN (SELECT name FROM nodes WHERE module IS NOT NULL)
        GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 10""",
    "busiest_out": """SELECT src AS name FROM depends
        WHERE src IN (SELECT name FROM nodes WHERE module IS NOT NULL)
        GROUP BY src ORDER BY count(*) DESC, src LIMIT 10""",
    "gmodules": "SELECT module AS name FROM modules UNION SELECT name FROM imports",
    "namespace_parts": """SELECT DISTINCT [x FOR x IN string_split(module, '.') IF x <> ''] AS parts
        FROM modules""",
    "namespaces": """SELECT DISTINCT array_to_string(parts[1:d], '.') AS name, d AS depth,
        CASE WHEN d > 1 THEN array_to_string(parts[1:d - 1], '.') END AS parent
        FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS d FROM namespace_parts)""",
    # ---- module graph
    "mnodes": """SELECT row_number() OVER (ORDER BY name) - 1 AS id, name
        FROM (SELECT module AS name FROM modules WHERE module LIKE 'Root.%')""",
    "mresolved": """SELECT a.id AS importer, b.id AS dep FROM imports i JOIN mnodes a ON a.name = i.module
        LEFT JOIN mnodes b ON b.name = i.name""",
    "medges": "SELECT DISTINCT importer, dep FROM mresolved WHERE dep IS NOT NULL AND dep <> importer",
    "mclosure": """SELECT importer AS node, dep FROM medges UNION
        SELECT c.node, e.dep FROM mclosure c JOIN medges e ON e.importer = c.dep""",
    "mpaths": """SELECT id, CAST(0 AS BIGINT) AS level FROM mnodes WHERE id NOT IN (SELECT importer FROM medges)
        UNION SELECT e.importer, p.level + 1 FROM mpaths p JOIN medges e ON e.dep = p.id""",
    "mlevels": "SELECT id, max(level) AS level FROM mpaths GROUP BY id",
    "mkeys": """SELECT id, level, [id] AS key FROM mlevels WHERE level = 0 UNION ALL
        SELECT e.importer, max(l.level), list_append(max(k.key), e.importer) FROM mkeys k
        JOIN medges e ON e.dep = k.id JOIN mlevels l ON l.id = e.importer AND l.level = k.level + 1
        GROUP BY e.importer""",
    "mtopo": "SELECT id, level, row_number() OVER (ORDER BY level, key) - 1 AS topo FROM mkeys",
    "msizes": """SELECT n.id, count(c.dep) AS closureSize FROM mnodes n LEFT JOIN mclosure c ON c.node = n.id
        GROUP BY n.id""",
    "mreduced": """SELECT importer, dep FROM medges e WHERE NOT EXISTS (SELECT 1 FROM medges d
        JOIN mclosure c ON c.node = d.dep WHERE d.importer = e.importer AND c.dep = e.dep)""",
    "mtopics": """SELECT n.id, n.name, coalesce(arg_min(t.id, t.priority), '_default') AS topic,
        coalesce(arg_min(t.y, t.priority), 140.0) AS band,
        coalesce(arg_min(t.color, t.priority), '#202020') AS color
        FROM mnodes n LEFT JOIN topics t ON t.id <> '_default' AND starts_with(n.name, 'Root.' || t.id || '.')
        GROUP BY n.id, n.name""",
    "mx": """SELECT s.id, s.closureSize, CASE WHEN s.closureSize = 0 THEN CAST(-(z.leaf % 10) AS DOUBLE)
        ELSE pow(s.closureSize, 0.72) END AS x FROM msizes s LEFT JOIN
        (SELECT id, row_number() OVER (ORDER BY id) - 1 AS leaf FROM msizes WHERE closureSize = 0) z
        ON z.id = s.id""",
    "pr_size": "SELECT count(*) AS n FROM mnodes",
    "pr_degree": "SELECT importer, count(*) AS degree FROM medges GROUP BY importer",
    "pr_0": "SELECT id, 1.0::DOUBLE / n AS v FROM mnodes, pr_size",
}
for _step in range(1, _ROUNDS + 1):
    CTES[f"pr_{_step}"] = f"""SELECT p.id, (1 - {_ALPHA})::DOUBLE / n + {_ALPHA}::DOUBLE * loose / n
        + coalesce(g.given, 0) AS v
        FROM pr_{_step - 1} p CROSS JOIN pr_size
        CROSS JOIN (SELECT coalesce(sum(v), 0) AS loose FROM pr_{_step - 1}
                    WHERE id NOT IN (SELECT importer FROM medges)) AS d
        LEFT JOIN (SELECT e.dep, sum({_ALPHA}::DOUBLE * q.v / w.degree) AS given FROM pr_{_step - 1} q
                   JOIN medges e ON e.importer = q.id JOIN pr_degree w ON w.importer = q.id
                   GROUP BY e.dep) AS g ON g.dep = p.id"""
CTES["pr_change"] = " UNION ALL ".join(
    f"SELECT {_s} AS step, sum(abs(b.v - a.v)) AS change FROM pr_{_s - 1} a JOIN pr_{_s} b ON a.id = b.id"
    for _s in range(1, _ROUNDS + 1)
)
CTES["pr_last"] = f"""SELECT coalesce(min(step) FILTER (change < {_TOL}), {_ROUNDS}) AS step FROM pr_change"""
CTES["mscores"] = "SELECT id, v AS score FROM (" + " UNION ALL ".join(
    f"SELECT {_s} AS step, id, v FROM pr_{_s}" for _s in range(1, _ROUNDS + 1)
) + ") AS rounds JOIN pr_last USING (step)"
CTES |= {
    "mradii": """SELECT id, 0.2 + 3.0 * sqrt((score - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END) AS r
        FROM mscores, (SELECT min(score) AS lo, max(score) AS hi FROM mscores)""",
    "mslots": """SELECT t.id, row_number() OVER (PARTITION BY CAST(trunc(x.x) AS BIGINT), p.topic ORDER BY t.topo) - 1
        AS slot FROM mtopo t JOIN mx x ON x.id = t.id JOIN mtopics p ON p.id = t.id""",
    "mmap": """SELECT o.topo, n.name, p.topic, x.x, p.band + CASE WHEN s.slot % 2 = 1 THEN (s.slot + 1) // 2
        ELSE -((s.slot + 1) // 2) END AS y, r.r, p.color, coalesce(c.n, 0) AS declCount, x.closureSize,
        m.isDeprecated, m.title, m.docstring[1:1000] AS docstring
        FROM mnodes n JOIN mtopo o ON o.id = n.id JOIN mtopics p ON p.id = n.id JOIN mx x ON x.id = n.id
        JOIN mradii r ON r.id = n.id JOIN mslots s ON s.id = n.id JOIN modules m ON m.module = n.name
        LEFT JOIN (SELECT module, count(*) AS n FROM declarations GROUP BY module) c ON c.module = n.name""",
    "mmap_edges": """SELECT d.name AS dep, i.name AS importer FROM mreduced e JOIN mnodes d ON d.id = e.dep
        JOIN mnodes i ON i.id = e.importer""",
    "homes": "SELECT name, arg_max(module, seq) AS module FROM extract WHERE module IS NOT NULL GROUP BY name",
    "raw_targets": """SELECT DISTINCT 'extends' AS rel, module AS src, dst AS target FROM extends
        UNION SELECT 'instantiates', module, instantiates FROM extract WHERE instantiates <> ''
        UNION SELECT 'fields', module, dst FROM fields""",
    "mstructure": """SELECT DISTINCT t.rel, t.src, coalesce(h.module, o.module) AS dst FROM raw_targets t
        LEFT JOIN homes h ON h.name = t.target
        LEFT JOIN homes o ON t.rel = 'fields' AND h.name IS NULL
          AND o.name = array_to_string(string_split(t.target, '.')[1:-2], '.')
        WHERE t.src IN (SELECT name FROM mnodes) AND coalesce(h.module, o.module) IN (SELECT name FROM mnodes)
          AND coalesce(h.module, o.module) <> t.src""",
    "relations": """SELECT 'import' AS rel, dep, importer FROM mmap_edges
        UNION ALL SELECT rel, dst, src FROM mstructure""",
    "hubs": """SELECT name FROM (SELECT dep AS name, count(*) AS n FROM mmap_edges GROUP BY dep)
        ORDER BY n DESC, name LIMIT 3""",
    "import_closure": """SELECT importer AS node, dep FROM mmap_edges UNION
        SELECT c.node, e.dep FROM import_closure c JOIN mmap_edges e ON e.importer = c.dep""",
    "near": """SELECT h.name AS origin, 'dep' AS side, e.dep AS node FROM hubs h JOIN mmap_edges e
        ON e.importer = h.name UNION SELECT h.name, 'dependent', e.importer FROM hubs h
        JOIN mmap_edges e ON e.dep = h.name""",
    "far": """SELECT h.name AS origin, 'dep' AS side, c.dep AS node FROM hubs h JOIN import_closure c
        ON c.node = h.name UNION SELECT h.name, 'dependent', c.node FROM hubs h
        JOIN import_closure c ON c.dep = h.name""",
    "selected": """SELECT origin, node, CASE min(r) WHEN 0 THEN 'focus' WHEN 1 THEN 'neighbor' ELSE 'closure' END
        AS role FROM (SELECT name AS origin, name AS node, 0 AS r FROM hubs UNION ALL
        SELECT origin, node, 1 FROM near UNION ALL SELECT origin, node, 2 FROM far) GROUP BY origin, node""",
    "salience": """SELECT e.dep, e.importer, a.r * b.r AS score FROM mmap_edges e JOIN mmap a ON a.name = e.dep
        JOIN mmap b ON b.name = e.importer""",
    # ---- blocks
    "brecords": "SELECT * FROM extract WHERE module IN (SELECT name FROM mnodes)",
    "bfirst": """SELECT module, name, min(seq) AS seq, arg_min(nConstructors, seq) AS nConstructors,
        arg_min(nExtends, seq) AS nExtends,
        max(CASE WHEN instantiates IS NOT NULL AND seq = first_seq THEN 1 ELSE 0 END) AS isInstance
        FROM (SELECT *, min(seq) OVER (PARTITION BY module, name) AS first_seq FROM brecords)
        GROUP BY module, name""",
    "bkinds": """SELECT f.module, f.name, f.seq, d.kind IS NULL AS inferred, coalesce(d.kind,
        CASE WHEN isInstance = 1 THEN 'instance' WHEN nConstructors > 0 THEN 'inductive'
             WHEN nExtends > 0 THEN 'class' ELSE 'def' END) AS k
        FROM bfirst f LEFT JOIN declarations d ON d.module = f.module AND d.name = f.name""",
    "bdecls": """SELECT *, row_number() OVER (PARTITION BY module ORDER BY seq, name) - 1 AS idx FROM bkinds""",
    "bhomes": "SELECT name, arg_max(module, seq) AS module FROM brecords GROUP BY name",
    "bedges": """SELECT DISTINCT s.module, s.idx AS src_idx, t.idx AS dst_idx FROM deps d
        JOIN bdecls s ON s.module = d.module AND s.name = d.src AND s.seq = d.seq
        JOIN bhomes h ON h.name = d.dst AND h.module = d.module
        JOIN bdecls t ON t.module = d.module AND t.name = d.dst WHERE d.src <> d.dst""",
    "bdegree": """SELECT module, idx, sum(o)::BIGINT AS outDegree, count(*) AS degree FROM (
        SELECT module, src_idx AS idx, 1 AS o FROM bedges UNION ALL SELECT module, dst_idx, 0 FROM bedges)
        GROUP BY module, idx""",
    "breach": """SELECT module, src_idx AS a, dst_idx AS b FROM bedges UNION
        SELECT r.module, r.a, e.dst_idx FROM breach r JOIN bedges e ON e.module = r.module AND e.src_idx = r.b""",
    "bstuck": """SELECT DISTINCT r.module, r.a AS idx FROM breach r
        JOIN breach c ON c.module = r.module AND c.a = c.b AND (c.a = r.b OR c.a = r.a)""",
    "bpaths": """SELECT module, idx, CAST(0 AS BIGINT) AS depth FROM bdecls d WHERE NOT EXISTS
        (SELECT 1 FROM bedges e WHERE e.module = d.module AND e.src_idx = d.idx)
        UNION SELECT e.module, e.src_idx, p.depth + 1 FROM bpaths p JOIN bedges e
        ON e.module = p.module AND e.dst_idx = p.idx
        WHERE NOT EXISTS (SELECT 1 FROM bstuck s WHERE s.module = e.module AND s.idx = e.src_idx)""",
    "bdepth": "SELECT module, idx, max(depth) AS depth FROM bpaths GROUP BY module, idx",
    "bcolumns": """SELECT module, idx, depth AS "column" FROM bdepth UNION ALL
        SELECT s.module, s.idx, coalesce(m.deepest, 0) + 1 FROM bstuck s LEFT JOIN
        (SELECT module, max(depth) AS deepest FROM bdepth GROUP BY module) m ON m.module = s.module""",
    "bslots": """SELECT *, row_number() OVER (PARTITION BY module, "column" ORDER BY idx) - 1 AS slot
        FROM bcolumns""",
    "bplaced": """SELECT d.module, d.idx, d.name, d.k, d.inferred, s."column"::DOUBLE AS x,
        1.5::DOUBLE * CASE WHEN s.slot % 2 = 1 THEN (s.slot + 1) // 2 ELSE -((s.slot + 1) // 2) END AS y,
        round(1.5::DOUBLE + least(3.0::DOUBLE, sqrt(coalesce(g.degree, 0))), 2) AS s
        FROM bdecls d JOIN bslots s ON s.module = d.module AND s.idx = d.idx
        LEFT JOIN bdegree g ON g.module = d.module AND g.idx = d.idx""",
    "brepeats": """SELECT module, name, count(*) - 1 AS repeats FROM brecords GROUP BY module, name
        HAVING count(*) > 1""",
    "bpieces": """SELECT module, 0 AS part, idx // 256 AS i, CAST(0 AS BIGINT) AS j, '[' || string_agg(
        '{"name":"' || name || '","k":"' || k || '","x":' || x::VARCHAR || ',"y":' || y::VARCHAR || ',"s":'
        || s::VARCHAR || '}', ',' ORDER BY idx) || ']' AS payload FROM bplaced GROUP BY module, idx // 256
        UNION ALL
        SELECT module, 1, src_idx // 256, dst_idx // 256, '[' || string_agg('[' || src_idx::VARCHAR || ','
        || dst_idx::VARCHAR || ']', ',' ORDER BY src_idx, dst_idx) || ']' FROM bedges
        GROUP BY module, src_idx // 256, dst_idx // 256""",
    "bindex": """SELECT *, strlen(payload)::BIGINT AS l, (coalesce(sum(strlen(payload))
        OVER (ORDER BY module, part, i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS o
        FROM bpieces""",
    # ---- rendered sources
    "file_imports": "SELECT module, count(*) AS n FROM imports GROUP BY module",
    "file_decls": """SELECT d.*, '/src/' || d.sourceFile AS path, d.seq % 29 = 0 AS nameless,
        5 + coalesce(i.n, 0) + CASE WHEN m.docstring IS NOT NULL THEN 9 ELSE 0 END
          + CASE WHEN m.isDeprecated THEN 1 ELSE 0 END + 1
          + 4 * (row_number() OVER (PARTITION BY d.module ORDER BY d.seq) - 1) + 3 AS start_line,
        5 + coalesce(i.n, 0) + CASE WHEN m.docstring IS NOT NULL THEN 9 ELSE 0 END
          + CASE WHEN m.isDeprecated THEN 1 ELSE 0 END + 2
          + 4 * count(*) OVER (PARTITION BY d.module) AS n_lines
        FROM declarations d JOIN modules m ON m.module = d.module LEFT JOIN file_imports i ON i.module = d.module""",
    "file_spans": """SELECT *, coalesce(lead(start_line) OVER (PARTITION BY module ORDER BY start_line), n_lines + 1)
        AS end_line FROM file_decls""",
    "file_paths": """SELECT '/src/' || m.path AS path, i.module, i.name, i.isPublic FROM imports i
        JOIN modules m ON m.module = i.module""",
}

_ALL = {**dict.fromkeys(fixture.TABLES), **CTES}
_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
_MULTI_USE = re.compile(r"pr_\d+$")


def _fixture_text(name: str) -> str:
    sql = fixture.TABLES[name].replace("{div}", "//")
    for source in ("part", "lineitem", *fixture.TABLES):
        sql = sql.replace(f"{{{source}}}", source)
    return sql


def with_ctes(sql: str) -> str:
    """``sql`` preceded by exactly the CTEs it needs, in dependency order."""
    ordered: list[str] = []
    visiting: set[str] = set()

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in _ALL and word not in visiting:
                visiting.add(word)
                visit(CTES.get(word) or _fixture_text(word))
                ordered.append(word)

    visit(sql)
    parts = []
    for name in ordered:
        hint = "MATERIALIZED " if _MULTI_USE.match(name) else ""
        parts.append(f"{name} AS {hint}({CTES.get(name) or _fixture_text(name)})")
    return f"WITH RECURSIVE {', '.join(parts)} {sql}" if parts else sql
