"""Dictionaries: terms of one to several words in texts, and the inverted index of conversations in ten categories.

A text is cut into words, each with the signs behind it. Where a word begins a term, the one to three words from there, with the signs
between them, are looked up as one value in a small table of terms; so a text is read once, however many terms there are, and no
pattern is tried on all texts. DuckDB's checks are written from the rules: a pattern for each term, and whole conversations joined."""

from __future__ import annotations

import re

from ..plans.dialect import Dialect, Registry

R = Registry()

# The word lists of the index, of the entity lists, and the display names of topics.
STOP_WORDS = (
    "the and a to of in i is that it on you this for but with are have be at or as was so if out not we my can they from do what about "
    "which when one their there all would how me will up an your by just like know get no some them then now into has more also any could "
    "should very much these those than use using used make want need way see think time good well where who why been had does our were don "
    "did didn only other"
).split()
INDEX = {
    "programming_languages": "python javascript java ruby php swift kotlin rust typescript html css sql c++ c# go bash shell".split(),
    "frameworks": "react angular vue django flask spring node express next.js nestjs laravel".split(),
    "products": "firebase aws azure gcp mysql postgres mongodb redis docker kubernetes figma notion chatgpt".split(),
    "companies": "google microsoft apple amazon facebook meta netflix openai anthropic oracle github gitlab vercel heroku stripe".split(),
}
#: The second category of what is in a first one.
ALSO = {"programming_languages": "technologies", "frameworks": "technologies", "products": "technologies", "companies": "projects"}
PHRASE = "oracle compiler"
ENTITIES = {
    "Programming Language": ["Python", "JavaScript", "Java", "C++", "C#", "Go", "Rust", "TypeScript", "Ruby", "PHP", "Swift", "Kotlin"],
    "Framework": ["React", "Angular", "Vue", "Django", "Flask", "Spring", "Express", "Ruby on Rails", "Next.js", "FastAPI"],
    "Technology": ["Docker", "Kubernetes", "AWS", "Azure", "GCP", "SQL", "NoSQL", "GraphQL", "REST", "Linux", "Git", "Kafka"],
    "Company": ["Google", "Microsoft", "Apple", "Amazon", "Meta", "OpenAI", "Oracle", "IBM", "Intel", "Nvidia", "Anthropic"],
    "Product": ["ChatGPT", "Gemini", "Claude", "Grok", "Copilot", "Windows", "macOS", "Linux", "iPhone"],
    "Person": ["Alan Turing", "Linus Torvalds", "Grace Hopper", "Ada Lovelace", "Tim Berners-Lee", "Bill Gates", "Steve Jobs", "Elon Musk"],
}
#: Display names that are more than a capital letter; all other topics are capitalized.
DISPLAY = {
    "javascript": "JavaScript", "typescript": "TypeScript", "node": "Node.js", "next.js": "Next.js", "nestjs": "NestJS", "fastapi": "FastAPI", "aws": "AWS", "gcp": "GCP", "mysql": "MySQL",
    "postgres": "PostgreSQL", "mongodb": "MongoDB", "sql": "SQL", "nosql": "NoSQL", "graphql": "GraphQL", "html": "HTML", "css": "CSS", "php": "PHP", "chatgpt": "ChatGPT", "openai": "OpenAI",
    "github": "GitHub", "gitlab": "GitLab", "oracle compiler": "Oracle Compiler",
}
TOPICS = ("technologies", "programming_languages", "frameworks", "products", "companies", "projects")
INDEX_FILES = "py js ts json txt md csv html css yml yaml xml sh".split()
ENTITY_FILES = "py md txt json csv yml yaml html js ts cpp c java go rs".split()
# End of fixed values.

#: Terms have so many words at most.
LONGEST = 3
PART, INNER = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
BLANK = r"\p{Z}\x09-\x0D\x1C-\x1F\x85"
DATE = "[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[-/][0-9]{2}[-/][0-9]{4}"
INDEX_URL = rf'https?://[^{BLANK}<>"]+|www[.][^{BLANK}<>"]+'
ENTITY_URL = r"https?://(?:[-.\p{L}\p{N}_]|%[0-9a-fA-F]{2})+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def dates(d: Dialect, x: str) -> str:
    """Dates that no letter or digit touches."""
    return d.matches(x, rf"(?<!{PART})(?:{DATE})(?!{PART})") if d.spark else d.matches(x, rf"\b(?:{DATE})\b")


def file_names(d: Dialect, x: str, endings: list[str]) -> str:
    return d.matches(x, rf"(?i)({PART}(?:{PART}|[.-])*[.](?:{'|'.join(endings)}))(?:{INNER}|$)", 1)


def gazetteer(d: Dialect, source: str, ids: str) -> str:
    """ids, type and term once for every listed term that stands in a text of source (with a column content) with word boundaries on
    both sides, whatever its case. A term that ends in a sign has its boundary only before a letter or digit."""
    listed = [(kind, term, term.lower()) for kind, terms in ENTITIES.items() for term in terms]
    if not d.spark:
        ends = lambda t: rf"({INNER}|$)" if t[-1].isalnum() else PART
        pattern = lambda low: quoted(f"(^|{INNER})" + "".join(c if c.isalnum() or c == " " else f"[{c}]" for c in low) + ends(low))
        return " UNION ALL ".join(f"SELECT {ids}, {quoted(k)} AS type, {quoted(t)} AS term FROM ({source}) s WHERE regexp_matches(lower(content), {pattern(low)})" for k, t, low in listed)
    first = ", ".join(sorted({quoted(re.match(r"\w+", low)[0]) for _, _, low in listed}))
    upto = lambda k: f"array_join(slice(p, i + 1, {k}), '')"
    bare = lambda x: f"regexp_replace({x}, r'{INNER}+$', '')"
    # What ends in a word, and, only where another word follows at once, what ends in its signs.
    keys = ", ".join(f"if(i + {k} <= size(p), {bare(upto(k))}, ''), if(i + {k} < size(p), {upto(k)}, '')" for k in range(1, LONGEST + 1))
    starts = f"filter(sequence(0, size(p) - 1), i -> {bare('p[i]')} IN ({first}))"
    found = f"if(size(p) = 0, array(), array_distinct(flatten(transform({starts}, i -> array({keys})))))"
    terms = ", ".join(f"({quoted(k)}, {quoted(t)}, {quoted(low)})" for k, t, low in listed)
    parts = d.matches("lower(coalesce(content, ''))", rf"{PART}+{INNER}*")
    return f"""
SELECT /*+ BROADCAST(g) */ {ids}, g.type, g.term FROM (SELECT {ids}, explode({found}) AS key FROM (SELECT {ids}, {parts} AS p FROM ({source}) s0) s1) s2
JOIN (SELECT * FROM VALUES {terms} AS v(type, term, key)) g ON g.key = s2.key"""


def entities(d: Dialect) -> str:
    """conv_id, message_id, type, value of each message: every occurrence of a URL, address, date or file name, and each listed term once."""
    kinds = {"URL": d.matches("content", ENTITY_URL), "Email Address": d.matches("content", EMAIL), "Date": dates(d, "content"), "File Name": file_names(d, "content", ENTITY_FILES)}
    found = " UNION ALL ".join(f"SELECT conv_id, message_id, '{k}' AS type, {d.each}({x}) AS value FROM v_chat" for k, x in kinds.items())
    return f"{found} UNION ALL SELECT conv_id, message_id, type, term FROM ({gazetteer(d, 'SELECT * FROM v_chat', 'conv_id, message_id')}) z"


GROUPS = "CASE WHEN type IN ('Technology', 'Programming Language', 'Framework', 'Product') THEN 'technologies' WHEN type = 'Person' THEN 'people' WHEN type = 'Company' THEN 'companies' END"


def entity_counts(d: Dialect) -> str:
    return f"SELECT category, value, count(*) AS n FROM (SELECT {GROUPS} AS category, value FROM ({entities(d)}) e) t WHERE category IS NOT NULL GROUP BY category, value"


def word_counts(d: Dialect) -> str:
    return f"SELECT conv_id, token, count(*) AS n FROM (SELECT conv_id, {d.each}({d.words('content')}) AS token FROM v_chat) w GROUP BY conv_id, token"


def index(d: Dialect) -> str:
    """category, token, conv_id once for each conversation that has the token in this category."""
    stops, listed = ", ".join(map(quoted, STOP_WORDS)), ", ".join(quoted(w) for ws in INDEX.values() for w in ws)
    if not d.spark:
        whole = "SELECT conv_id, string_agg(content, ' ' ORDER BY msg_index) AS text FROM v_chat WHERE content <> '' GROUP BY conv_id"
        words = f"SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest({d.matches('lower(text)', PART + '+')}) AS w FROM ({whole}) c) t WHERE regexp_full_match(w, '[a-z]{{2,}}') GROUP BY conv_id, w"
        known = " UNION ALL ".join(f"SELECT conv_id, '{c}' AS category, w AS token FROM ({words}) x WHERE w IN ({', '.join(map(quoted, ws))})" for name, ws in INDEX.items() for c in (name, ALSO[name]))
        found = {"urls": d.matches("text", INDEX_URL), "file_names": file_names(d, "lower(text)", INDEX_FILES), "dates": dates(d, "text")}
        others = " UNION ALL ".join(f"SELECT conv_id, '{c}', unnest({x}) FROM ({whole}) c" for c, x in found.items())
        rest = f"SELECT conv_id, 'keywords', w FROM ({words}) x WHERE n >= 2 AND length(w) > 2 AND w NOT IN ({listed}) AND w NOT IN ({stops})"
        return f"SELECT DISTINCT category, token, conv_id FROM ({known} UNION ALL {others} UNION ALL {rest} UNION ALL SELECT conv_id, 'projects', '{PHRASE}' FROM ({whole}) c WHERE contains(lower(text), '{PHRASE}')) u"
    terms = ", ".join(f"({quoted(w)}, array({quoted(name)}, {quoted(ALSO[name])}))" for name, ws in INDEX.items() for w in ws)
    known = f"""
SELECT /*+ BROADCAST(g) */ w.conv_id, explode(coalesce(g.categories, array('keywords'))) AS category, w.token FROM ({word_counts(d)}) w
LEFT JOIN (SELECT * FROM VALUES {terms} AS v(token, categories)) g ON g.token = w.token
WHERE g.token IS NOT NULL OR (w.n >= 2 AND length(w.token) > 2 AND w.token NOT IN ({stops}))"""
    found = {"urls": d.matches("content", INDEX_URL), "file_names": file_names(d, "lower(content)", INDEX_FILES), "dates": dates(d, "content")}
    others = " UNION ALL ".join(f"SELECT conv_id, '{c}' AS category, explode({x}) AS token FROM v_chat" for c, x in found.items())
    # The phrase in a message, or at the end of one and the beginning of the next.
    one, two = PHRASE.split()
    phrase = f"SELECT conv_id, 'projects', '{PHRASE}' FROM v_chat WHERE lower(content) LIKE '%{PHRASE}%'"
    across = f"SELECT /*+ MERGE(b) */ a.conv_id, 'projects', '{PHRASE}' FROM (SELECT conv_id, msg_index FROM v_chat WHERE lower(content) LIKE '%{one}') a JOIN (SELECT conv_id, msg_index FROM v_chat WHERE lower(content) LIKE '{two}%') b ON b.conv_id = a.conv_id AND b.msg_index = a.msg_index + 1"
    return f"SELECT category, token, conv_id FROM ({known}) k UNION ALL SELECT DISTINCT category, token, conv_id FROM ({others} UNION ALL {phrase} UNION ALL {across}) o"


def display(d: Dialect, token: str) -> str:
    """A topic's name: listed, or the token with a capital letter and small ones behind."""
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in DISPLAY.items())
    if d.spark:
        return f"CASE lower({token}) {cases} ELSE concat(upper(substring({token}, 1, 1)), lower(substring({token}, 2))) END"
    return f"coalesce(list_extract(element_at(MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in DISPLAY.items())}}}, lower({token})), 1), upper({token}[1]) || lower({token}[2:]))"


def topics(d: Dialect) -> str:
    """topic, conv_id of the conversations of each topic that has two at least."""
    of = f"SELECT DISTINCT {display(d, 'token')} AS topic, conv_id FROM ({index(d)}) i WHERE category IN ({', '.join(map(quoted, TOPICS))})"
    return of if d.spark else f"SELECT topic, conv_id FROM ({of}) t QUALIFY count(*) OVER (PARTITION BY topic) >= 2"


def topic_counts(d: Dialect) -> str:
    return f"SELECT topic, count(*) AS n FROM ({topics(d)}) t GROUP BY topic" + (" HAVING count(*) >= 2" if d.spark else "")


@R.add("join_gazetteer")
def _(d: Dialect) -> str:
    return gazetteer(d, "SELECT doc_id, content FROM v_signal_text", "doc_id")


@R.add("set_entity_union")
def _(d: Dialect) -> str:
    """All that is named in a document: its language, the listed terms, URLs and addresses."""
    found = " UNION ALL ".join(f"SELECT doc_id, {d.each}({d.matches('content', p)}) AS term FROM v_signal_text" for p in (ENTITY_URL, EMAIL))
    return f"SELECT doc_id, {d.joined_set('term')} AS entities FROM (SELECT doc_id, lang AS term FROM documents UNION ALL SELECT doc_id, term FROM ({R['join_gazetteer'](d)}) g0 UNION ALL {found}) e GROUP BY doc_id"


@R.add("fn_regex_entities")
def _(d: Dialect) -> str:
    return f"SELECT message_id, type, value FROM ({entities(d)}) e WHERE type IN ('URL', 'Email Address', 'Date', 'File Name')"


@R.add("fn_regex_index_terms")
def _(d: Dialect) -> str:
    return f"SELECT category, token, conv_id FROM ({index(d)}) i WHERE category IN ('urls', 'file_names', 'dates')"


@R.add("fn_regex_v2")
def _(d: Dialect) -> str:
    """Addresses and URLs of a document, each once."""
    return " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{k}' AS type, {d.each}({d.matches('content', p)}) AS value FROM v_signal_text" for k, p in (("email", EMAIL), ("url", rf"https?://[^{BLANK}]+")))


@R.add("fn_temporal_signals")
def _(d: Dialect) -> str:
    return f"SELECT message_id, {d.joined_set('day')} AS days FROM (SELECT message_id, {d.each}({dates(d, 'content')}) AS day FROM v_chat) t GROUP BY message_id"


@R.add("flt_browse_entities")
def _(d: Dialect) -> str:
    return f"SELECT type, value FROM ({entities(d)}) e WHERE type = 'URL' AND (lower(value) LIKE '%ex3%' OR CAST(conv_id AS {d.text}) LIKE '%ex3%')"


@R.add("join_entities_per_conv")
def _(d: Dialect) -> str:
    """Every conversation with its entities, a row each; a conversation without any has a row of its own."""
    hint = "/*+ MERGE(e) */ " if d.spark else ""
    return f"SELECT {hint}c.conv_id, e.type, e.value, e.n FROM v_conversations c LEFT JOIN (SELECT conv_id, type, value, count(*) AS n FROM ({entities(d)}) x GROUP BY conv_id, type, value) e ON e.conv_id = c.conv_id"


@R.add("join_entity_denorm")
def _(d: Dialect) -> str:
    hint = "/*+ MERGE(c) */ " if d.spark else ""
    return f"SELECT {hint}e.message_id, e.type, e.value, c.source_platform, c.source FROM ({entities(d)}) e LEFT JOIN v_conversations c ON c.conv_id = e.conv_id"


@R.add("agg_entity_counts")
def _(d: Dialect) -> str:
    return entity_counts(d)


@R.add("top_entities")
def _(d: Dialect) -> str:
    return f"SELECT category, value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, value) AS place FROM ({entity_counts(d)}) c) t WHERE place <= 25"


@R.add("agg_inverted_index")
def _(d: Dialect) -> str:
    """The index as postings: a row for each conversation of a token, so no token's conversations are gathered in one value."""
    return index(d)


@R.add("agg_keywords")
def _(d: Dialect) -> str:
    return f"SELECT conv_id, token FROM ({index(d)}) i WHERE category = 'keywords'"


@R.add("agg_doc_frequency")
def _(d: Dialect) -> str:
    return f"SELECT category, token, n FROM (SELECT category, token, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, token) AS place FROM (SELECT category, token, count(*) AS n FROM ({index(d)}) i GROUP BY category, token) c) t WHERE place <= 25"


@R.add("agg_topic_map")
def _(d: Dialect) -> str:
    return topic_counts(d)


@R.add("top_topics")
def _(d: Dialect) -> str:
    return f"{topic_counts(d)} ORDER BY n DESC, topic"


@R.add("join_anti_general")
def _(d: Dialect) -> str:
    """Conversations of no topic of two conversations and more."""
    if d.spark:
        kept = f"SELECT /*+ MERGE(m) */ t.conv_id FROM ({topics(d)}) t JOIN ({topic_counts(d)}) m ON m.topic = t.topic"
        return f"SELECT /*+ MERGE(k) */ c.conv_id FROM v_conversations c LEFT ANTI JOIN (SELECT DISTINCT conv_id FROM ({kept}) k0) k ON k.conv_id = c.conv_id"
    return f"SELECT conv_id FROM v_conversations EXCEPT SELECT conv_id FROM ({topics(d)}) t"


@R.add("fn_display_name")
def _(d: Dialect) -> str:
    return f"SELECT token, {display(d, 'token')} AS topic FROM (SELECT DISTINCT token FROM ({index(d)}) i) t"


@R.add("fn_multiword_marker")
def _(d: Dialect) -> str:
    return f"SELECT doc_id, CASE WHEN {'contains' if d.spark else 'contains'}(lower(content), '{PHRASE}') THEN 'Oracle Compiler' END AS project FROM v_signal_text"
