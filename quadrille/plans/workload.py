"""Queries over the mapped tables, each with the SQL it must agree with."""

from __future__ import annotations

BANDS = 'VALUES (?low ?high ?band) { (1.0 10.0 "small") (11.0 25.0 "medium") (26.0 49.0 "large") }'
_BAND_SQL = "(VALUES (1.0, 10.0, 'small'), (11.0, 25.0, 'medium'), (26.0, 49.0, 'large')) b(low, high, band)"

#: name -> (query, SQL)
QUERIES: dict[str, tuple[str, str]] = {
    "region_customers": (
        "SELECT ?answer (COUNT(?c) AS ?customers) WHERE { ?c a :Customer ; :nation/:region ?r . ?r rdfs:label ?answer . } GROUP BY ?answer ORDER BY ?answer",
        "SELECT r_name AS answer, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "bgp_constant_subject": ("SELECT ?total ?status WHERE { :Order7 :total ?total ; :status ?status . }", "SELECT o_totalprice AS total, o_orderstatus AS status FROM orders WHERE o_orderkey = 7"),
    "bgp_object_hop_label": ("SELECT ?answer WHERE { :Nation3 :region ?r . ?r rdfs:label ?answer . }", "SELECT r_name AS answer FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3"),
    "bgp_star_multi_column": ("SELECT ?name ?segment ?balance WHERE { ?c a :Customer ; rdfs:label ?name ; :segment ?segment ; :balance ?balance . }", "SELECT c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer"),
    "bgp_object_list": ('SELECT ?name WHERE { ?c :segment "BUILDING" , ?s ; rdfs:label ?name . }', "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "bgp_reverse_lookup": ("SELECT ?answer WHERE { ?s :nation :Nation5 ; a :Supplier ; rdfs:label ?answer . }", "SELECT s_name AS answer FROM supplier WHERE s_nationkey = 5"),
    "bgp_chain_four_hop": (
        "SELECT ?region (SUM(?q) AS ?quantity) WHERE { ?l :order/:customer/:nation/:region ?r ; :quantity ?q . ?r rdfs:label ?region . } GROUP BY ?region",
        "SELECT r_name AS region, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "bgp_cross_disconnected": ("SELECT ?a ?b WHERE { ?x a :Region ; rdfs:label ?a . ?y a :Region ; rdfs:label ?b . }", "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y"),
    "bgp_variable_predicate": ("SELECT ?n WHERE { :Region2 ?p ?n . FILTER (isLiteral(?n)) }", "SELECT r_name AS n FROM region WHERE r_regionkey = 2"),
    "class_listing": ("SELECT ?answer ?brand WHERE { ?x a :Part ; rdfs:label ?answer ; :brand ?brand . }", "SELECT p_name AS answer, p_brand AS brand FROM part"),
    "path_sequence": ("SELECT DISTINCT ?nation ?region WHERE { ?c a :Customer ; :nation ?n . ?n rdfs:label ?nation ; :region/rdfs:label ?region . }", "SELECT DISTINCT n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_inverse": ("SELECT ?answer WHERE { :Region1 ^:region/rdfs:label ?answer . }", "SELECT n_name AS answer FROM nation WHERE n_regionkey = 1"),
    "path_alternative": ("SELECT ?key ?v WHERE { ?p a :Part ; rdfs:label ?key ; :brand|:partType ?v . }", "SELECT p_name AS key, p_brand AS v FROM part UNION ALL SELECT p_name, p_type FROM part"),
    "path_optional": ("SELECT DISTINCT ?v WHERE { :Nation4 :region?/rdfs:label ?v . }", "SELECT n_name AS v FROM nation WHERE n_nationkey = 4 UNION SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 4"),
    "path_negated": ("SELECT ?v WHERE { :Supplier3 !(rdfs:label|:nation|rdf:type) ?v . }", "SELECT CAST(s_acctbal AS VARCHAR) AS v FROM supplier WHERE s_suppkey = 3"),
    "filter_numeric_and": ("SELECT ?name ?size WHERE { ?p a :Part ; rdfs:label ?name ; :size ?size ; :price ?price . FILTER (10 <= ?size && ?size < 20 && ?price > 950.5) }", "SELECT p_name AS name, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 950.5"),
    "filter_or_not": ('SELECT ?name WHERE { ?p a :Part ; rdfs:label ?name ; :size ?size ; :brand ?b . FILTER (!(?size > 3) || ?b = "Brand#11") }', "SELECT p_name AS name FROM part WHERE NOT p_size > 3 OR p_brand = 'Brand#11'"),
    "filter_str_equals": ('SELECT ?key WHERE { ?c :segment ?s ; rdfs:label ?key . FILTER (STR(?s) = "MACHINERY") }', "SELECT c_name AS key FROM customer WHERE c_mktsegment = 'MACHINERY'"),
    "filter_in": ("SELECT ?name ?size WHERE { ?p a :Part ; rdfs:label ?name ; :size ?size . FILTER (?size IN (1, 7, 49)) }", "SELECT p_name AS name, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size IN (1, 7, 49)"),
    "filter_not_in": ('SELECT ?priority (COUNT(*) AS ?n) WHERE { ?o a :Order ; :priority ?priority . FILTER (?priority NOT IN ("1-URGENT", "5-LOW")) } GROUP BY ?priority', "SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY 1"),
    "filter_regex": ('SELECT ?name WHERE { ?c a :Customer ; rdfs:label ?name . FILTER (REGEX(?name, "0[13]$")) }', "SELECT c_name AS name FROM customer WHERE regexp_matches(c_name, '0[13]$')"),
    "filter_bound": ("SELECT (COUNT(*) AS ?n) WHERE { ?d a :Document . OPTIONAL { ?l :document ?d ; :quality ?q . } FILTER (!BOUND(?q)) }", "SELECT count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL"),
    "filter_exists": ("SELECT (COUNT(*) AS ?n) WHERE { ?o a :Order ; :status ?s . FILTER EXISTS { ?l :order ?o ; :quantity ?q . FILTER (?q >= 45) } }", "SELECT count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)"),
    "filter_not_exists": ("SELECT ?total WHERE { ?o a :Order ; :total ?total . FILTER NOT EXISTS { ?l :order ?o . } }", "SELECT o_totalprice AS total FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "filter_exists_or": ("SELECT (COUNT(*) AS ?n) WHERE { ?o a :Order ; :total ?t . FILTER (?t > 400000 || NOT EXISTS { ?l :order ?o . }) }", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 400000 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "minus_shared": ("SELECT (COUNT(*) AS ?n) WHERE { ?c a :Customer . MINUS { ?o :customer ?c . } }", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "minus_disjoint": ("SELECT (COUNT(*) AS ?n) WHERE { ?c a :Region . MINUS { ?o a :Nation . } }", "SELECT count(*) AS n FROM region"),
    "optional_left_join": (
        "SELECT ?chars (COALESCE(?q, -1) AS ?quality) WHERE { ?d a :Document ; :chars ?chars . OPTIONAL { ?l :document ?d ; :quality ?q . } }",
        "SELECT n_chars AS chars, coalesce(CAST(quality AS BIGINT), -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    ),
    "optional_inner_filter": (
        "SELECT ?total ?q WHERE { ?o a :Order ; :total ?total . OPTIONAL { ?l :order ?o ; :extended ?e ; :quantity ?q . FILTER (?e * 4 > ?total) } }",
        "SELECT o_totalprice AS total, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_extendedprice * 4 > o_totalprice",
    ),
    "union_branches": ("SELECT ?name ?balance WHERE { { ?x a :Customer ; rdfs:label ?name ; :balance ?balance . FILTER (?balance < 0) } UNION { ?x a :Supplier ; rdfs:label ?name . } }", "SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_name, NULL FROM supplier"),
    "bind_expression": ("SELECT ?name ?twice WHERE { ?p a :Part ; rdfs:label ?name ; :size ?s . BIND (?s * 2 + 1 AS ?twice) }", "SELECT p_name AS name, CAST(p_size AS BIGINT) * 2 + 1 AS twice FROM part"),
    "values_inline": ("SELECT ?answer WHERE { VALUES ?n { :Nation1 :Nation2 :Nation1 } ?n rdfs:label ?answer . } ORDER BY ?answer", "SELECT n_name AS answer FROM nation JOIN (VALUES (1), (2), (1)) v(k) ON n_nationkey = k"),
    "values_literals": ('SELECT ?s (COUNT(*) AS ?n) WHERE { VALUES ?s { "BUILDING" "MACHINERY" } ?c :segment ?s . } GROUP BY ?s', "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1"),
    "subselect_join": (
        "SELECT ?name ?orders WHERE { ?c rdfs:label ?name . { SELECT ?c (COUNT(?o) AS ?orders) WHERE { ?o :customer ?c . } GROUP BY ?c } FILTER (?orders > 12) }",
        "SELECT c_name AS name, orders FROM customer JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE orders > 12",
    ),
    "select_distinct": ("SELECT DISTINCT ?flag WHERE { ?l a :Line ; :returnFlag ?flag . }", "SELECT DISTINCT l_returnflag AS flag FROM lineitem"),
    "select_distinct_multi": ("SELECT DISTINCT ?flag ?status ?d WHERE { ?l :returnFlag ?flag ; :lineStatus ?status ; :discount ?d . }", "SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status, l_discount AS d FROM lineitem"),
    "select_reduced": ("SELECT REDUCED ?name WHERE { ?r a :Region ; rdfs:label ?name . }", "SELECT r_name AS name FROM region"),
    "agg_count_distinct": ("SELECT (COUNT(DISTINCT ?p) AS ?answer) WHERE { ?l :supplier :Supplier1 ; :part ?p . }", "SELECT count(DISTINCT l_partkey) AS answer FROM lineitem WHERE l_suppkey = 1"),
    "agg_group_count_distinct": ("SELECT ?flag (COUNT(DISTINCT ?o) AS ?orders) WHERE { ?l :returnFlag ?flag ; :order ?o . } GROUP BY ?flag", "SELECT l_returnflag AS flag, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1"),
    "agg_sum_avg_min_max": (
        "SELECT ?flag (ROUND(SUM(?e)) AS ?total) (ROUND(AVG(?q) * 1000) AS ?mean) (MIN(?d) AS ?low) (MAX(?d) AS ?high) (COUNT(*) AS ?n) WHERE { ?l :returnFlag ?flag ; :extended ?e ; :quantity ?q ; :discount ?d . } GROUP BY ?flag",
        "SELECT l_returnflag AS flag, floor(sum(l_extendedprice) + 0.5) AS total, floor(avg(l_quantity) * 1000 + 0.5) AS mean, min(l_discount) + 0.0 AS low, max(l_discount) AS high, count(*) AS n FROM lineitem GROUP BY 1",
    ),
    "agg_having": ("SELECT ?c (COUNT(*) AS ?n) WHERE { ?o :customer ?x . ?x :segment ?c . } GROUP BY ?c HAVING (COUNT(*) > 2000)", "SELECT c_mktsegment AS c, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 2000"),
    "agg_group_concat": ('SELECT ?region (GROUP_CONCAT(?n; SEPARATOR=", ") AS ?nations) WHERE { ?x a :Nation ; rdfs:label ?n ; :region/rdfs:label ?region . } GROUP BY ?region', "SELECT r_name AS region, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "agg_implicit_group": ('SELECT (COUNT(?c) AS ?n) (SUM(?b) AS ?total) WHERE { ?c :segment "NOWHERE" ; :balance ?b . }', "SELECT count(*) AS n, coalesce(sum(c_acctbal), 0) AS total FROM customer WHERE c_mktsegment = 'NOWHERE'"),
    "agg_group_expression": ("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :orderDate ?d . } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "agg_sample": ("SELECT (SAMPLE(?n) AS ?answer) WHERE { :Region0 rdfs:label ?n . }", "SELECT r_name AS answer FROM region WHERE r_regionkey = 0"),
    "order_limit_topk": ("SELECT ?total ?priority WHERE { ?o :total ?total ; :priority ?priority . } ORDER BY DESC(?total) ?priority LIMIT 10", "SELECT o_totalprice AS total, o_orderpriority AS priority FROM orders ORDER BY 1 DESC, 2 LIMIT 10"),
    "order_offset": ("SELECT ?name WHERE { ?p a :Part ; rdfs:label ?name ; :price ?v . } ORDER BY ?v ?name LIMIT 15 OFFSET 20", "SELECT p_name AS name FROM part ORDER BY p_retailprice, p_name LIMIT 15 OFFSET 20"),
    "band_range_join": (
        f"SELECT ?band (COUNT(*) AS ?n) WHERE {{ {BANDS} ?l a :Line ; :quantity ?q . FILTER (?low <= ?q && ?q <= ?high) }} GROUP BY ?band",
        f"SELECT band, count(*) AS n FROM lineitem JOIN {_BAND_SQL} ON low <= l_quantity AND l_quantity <= high GROUP BY 1",
    ),
    "band_inclusive_flags": (
        'SELECT ?year (COUNT(*) AS ?n) WHERE { VALUES (?low ?lowIn ?high ?highIn ?year) { (1.0 true 10.0 true "first") (10.0 false 30.0 false "second") (30.0 true 60.0 true "third") } ?l a :Line ; :quantity ?q . FILTER (IF(?lowIn, ?low <= ?q, ?low < ?q) && IF(?highIn, ?q <= ?high, ?q < ?high)) } GROUP BY ?year',
        "SELECT year, count(*) AS n FROM lineitem JOIN (VALUES (1.0, true, 10.0, true, 'first'), (10.0, false, 30.0, false, 'second'), (30.0, true, 60.0, true, 'third')) b(low, low_in, high, high_in, year) ON CASE WHEN low_in THEN low <= l_quantity ELSE low < l_quantity END AND CASE WHEN high_in THEN l_quantity <= high ELSE l_quantity < high END GROUP BY 1",
    ),
    "band_open_ended": (
        'SELECT ?band (COUNT(*) AS ?n) WHERE { VALUES (?low ?high ?band) { (UNDEF 5.0 "low") (5.5 45.0 "mid") (45.5 UNDEF "high") } ?l a :Line ; :quantity ?q . FILTER ((!BOUND(?low) || ?low <= ?q) && (!BOUND(?high) || ?q <= ?high)) } GROUP BY ?band ?low ?high',
        "SELECT band, count(*) AS n FROM lineitem JOIN (VALUES (NULL, 5.0, 'low'), (5.5, 45.0, 'mid'), (45.5, NULL, 'high')) b(low, high, band) ON (low IS NULL OR low <= l_quantity) AND (high IS NULL OR l_quantity <= high) GROUP BY band, low, high",
    ),
    "asof_latest": (
        'SELECT ?total WHERE { ?o :customer :Customer7 ; :orderDate ?d ; :total ?total . FILTER (?d <= "1997-06-01T00:00:00"^^xsd:dateTime) } ORDER BY DESC(?d) DESC(?total) LIMIT 1',
        "SELECT o_totalprice AS total FROM orders WHERE o_custkey = 7 AND o_orderdate <= TIMESTAMP '1997-06-01' ORDER BY o_orderdate DESC, o_totalprice DESC LIMIT 1",
    ),
    "asof_with_default": (
        "SELECT ?rate WHERE { VALUES (?rate ?since) { (500 UNDEF) (600 63) (620 66) } FILTER (!BOUND(?since) || 65 >= ?since) } ORDER BY DESC(?since) LIMIT 1",
        "SELECT CAST(600 AS BIGINT) AS rate",
    ),
    "reverse_by_value": ("SELECT ?name WHERE { ?p a :Part ; :size 21 ; rdfs:label ?name . }", "SELECT p_name AS name FROM part WHERE p_size = 21"),
    "string_functions": (
        'SELECT ?a ?b ?c ?d ?e WHERE { ?n a :Nation ; rdfs:label ?x . BIND (UCASE(SUBSTR(?x, 2, 3)) AS ?a) BIND (STRLEN(?x) AS ?b) BIND (CONCAT(STRBEFORE(?x, "_"), "-", STRAFTER(?x, "_")) AS ?c) BIND (REPLACE(?x, "[aeiouAEIOU]", "*") AS ?d) BIND (IF(STRSTARTS(?x, "N") && CONTAINS(?x, "1") && STRENDS(?x, "1"), "yes", LCASE(?x)) AS ?e) }',
        "SELECT upper(substr(n_name, 2, 3)) AS a, length(n_name) AS b, (CASE WHEN contains(n_name, '_') THEN split_part(n_name, '_', 1) ELSE '' END) || '-' || (CASE WHEN contains(n_name, '_') THEN substr(n_name, strpos(n_name, '_') + 1) ELSE '' END) AS c, regexp_replace(n_name, '[aeiouAEIOU]', '*', 'g') AS d, CASE WHEN starts_with(n_name, 'N') AND contains(n_name, '1') AND suffix(n_name, '1') THEN 'yes' ELSE lower(n_name) END AS e FROM nation",
    ),
    "numeric_functions": (
        "SELECT ?name ?a ?b ?c ?d WHERE { ?s a :Supplier ; rdfs:label ?name ; :balance ?v . BIND (ABS(?v) AS ?a) BIND (CEIL(?v) AS ?b) BIND (FLOOR(?v) AS ?c) BIND (ROUND(?v / 7) AS ?d) }",
        "SELECT s_name AS name, abs(s_acctbal) AS a, ceil(s_acctbal) AS b, floor(s_acctbal) AS c, floor(s_acctbal / 7 + 0.5) AS d FROM supplier",
    ),
    "date_functions": (
        "SELECT ?y ?m (COUNT(*) AS ?n) (MAX(?x) AS ?last) WHERE { ?e a :Event ; :time ?t . BIND (YEAR(?t) AS ?y) BIND (MONTH(?t) AS ?m) BIND (DAY(?t) * 24 + HOURS(?t) AS ?x) } GROUP BY ?y ?m",
        "SELECT year(ts) AS y, month(ts) AS m, count(*) AS n, max(day(ts) * 24 + hour(ts)) AS last FROM events GROUP BY 1, 2",
    ),
    "hash_functions": ("SELECT ?a ?b ?c WHERE { ?r a :Region ; rdfs:label ?x . BIND (MD5(?x) AS ?a) BIND (SHA1(?x) AS ?b) BIND (SHA256(?x) AS ?c) }", "SELECT md5(r_name) AS a, sha1(r_name) AS b, sha256(r_name) AS c FROM region"),
    "term_tests": (
        'SELECT ?name ?a ?b ?c ?d ?e WHERE { ?n a :Nation ; rdfs:label ?name ; :region ?r . BIND (isIRI(?r) AS ?a) BIND (isLiteral(?name) AS ?b) BIND (isNumeric(?name) AS ?c) BIND (sameTerm(?r, :Region1) AS ?d) BIND (COALESCE(?nothing, LANG(?name), "x") AS ?e) }',
        "SELECT n_name AS name, true AS a, true AS b, false AS c, n_regionkey = 1 AS d, '' AS e FROM nation",
    ),
    "term_casts": (
        "SELECT ?name ?i ?s ?b WHERE { ?p a :Part ; rdfs:label ?name ; :size ?z . BIND (xsd:integer(STR(?z)) + 1 AS ?i) BIND (xsd:string(?z) AS ?s) BIND (xsd:boolean(?z - 1) AS ?b) }",
        "SELECT p_name AS name, CAST(p_size AS BIGINT) + 1 AS i, CAST(p_size AS VARCHAR) AS s, p_size <> 1 AS b FROM part",
    ),
    # Rows of a table without a key are nodes too, the same ones in every scan.
    "keyless_optional": ("SELECT (COUNT(?q) AS ?n) (SUM(?q) AS ?t) WHERE { ?l :lineNumber 3 . OPTIONAL { ?l :quantity ?q } }", "SELECT count(l_quantity) AS n, sum(l_quantity) AS t FROM lineitem WHERE l_linenumber = 3"),
    "keyless_exists": ("SELECT (COUNT(*) AS ?n) (SUM(?q) AS ?t) WHERE { ?l :lineNumber 3 ; :quantity ?q . FILTER EXISTS { ?l :discount ?d . FILTER (?d > 0.05) } }", "SELECT count(*) AS n, sum(l_quantity) AS t FROM lineitem WHERE l_linenumber = 3 AND l_discount > 0.05"),
    "keyless_not_exists": ("SELECT (COUNT(*) AS ?n) (SUM(?q) AS ?t) WHERE { ?l :lineNumber 3 ; :quantity ?q . FILTER NOT EXISTS { ?l :discount ?d . FILTER (?d > 0.05) } }", "SELECT count(*) AS n, sum(l_quantity) AS t FROM lineitem WHERE l_linenumber = 3 AND NOT l_discount > 0.05"),
    "keyless_minus": ("SELECT (COUNT(*) AS ?n) (SUM(?q) AS ?t) WHERE { ?l :lineNumber 3 ; :quantity ?q . MINUS { ?l :returnFlag \"R\" . } }", "SELECT count(*) AS n, sum(l_quantity) AS t FROM lineitem WHERE l_linenumber = 3 AND l_returnflag <> 'R'"),
    "keyless_subselect": ("SELECT (COUNT(?q) AS ?n) (SUM(?q) AS ?t) WHERE { ?l :lineNumber 3 . { SELECT ?l ?q WHERE { ?l :quantity ?q . FILTER (?q > 10) } } }", "SELECT count(*) AS n, sum(l_quantity) AS t FROM lineitem WHERE l_linenumber = 3 AND l_quantity > 10"),
    # Joins on variables that may be unbound, or are computed.
    "join_on_optional": (
        "SELECT ?name ?chars WHERE { ?d a :Document ; :chars ?chars ; :source ?s . OPTIONAL { ?l :document ?d ; :quality ?q . } OPTIONAL { ?n a :Nation ; rdfs:label ?name . BIND (1 AS ?q) FILTER (?n = :Nation3) } }",
        "SELECT CASE WHEN quality IS NULL OR quality = 1 THEN (SELECT n_name FROM nation WHERE n_nationkey = 3) END AS name, n_chars AS chars FROM documents LEFT JOIN labels USING (doc_id)",
    ),
    "join_on_bind": ("SELECT ?a ?b WHERE { ?p a :Part ; rdfs:label ?a ; :size ?z . BIND (?z + 1 AS ?k) { SELECT ?k (MIN(?m) AS ?b) WHERE { ?q a :Part ; rdfs:label ?m ; :size ?k . } GROUP BY ?k } }", "SELECT p_name AS a, b FROM part JOIN (SELECT p_size AS k, min(p_name) AS b FROM part GROUP BY 1) ON p_size + 1 = k"),
    "join_on_max": ("SELECT ?name ?t WHERE { { SELECT ?c (MAX(?total) AS ?t) WHERE { ?o :customer ?c ; :total ?total . } GROUP BY ?c } ?o2 :total ?t ; :customer ?c . ?c rdfs:label ?name . }", "SELECT c_name AS name, t FROM (SELECT o_custkey AS c, max(o_totalprice) AS t FROM orders GROUP BY 1) m JOIN orders ON o_custkey = c AND o_totalprice = t JOIN customer ON c_custkey = c"),
}
