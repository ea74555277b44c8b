"""The license scan in SQL, written apart from the automata: each word stands between spaces of its own."""

from __future__ import annotations

_BASE = {"cc-by": ("cc  by", 2), "gpl": ("general  public  license", 3), "reserved": ("all  rights  reserved", 3)}
# The templates as expressions over words with a space on each side.
_TEMPLATES = {
    "apache-2.0": " licensed  under  the  apache  license ( version )? 2  0 ",
    "bsd": " redistribution  and  use  in  source  and  binary  forms  with  or  without  modification  are  permitted ",
    "cc-by-4.0": " cc  by  4  0 ",
    "cc-by-nc-4.0": " cc  by  nc  4  0 ",
    "cc-by-sa-4.0": " cc  by  sa  4  0 ",
    "copyright": " copyright ( c )?( [^ ]+ ){1,8} all  rights  reserved ",
    "gpl-3.0": " gnu  general  public  license ( as  published  by  the  free  software  foundation )?( either )? version  3 ",
    "mit": " under  the ( terms  of  the )? mit  license | permission  is  hereby  granted  free  of  charge  to  any  person"
           "  obtaining  a  copy  of ( [^ ]+ ){1,8} associated  documentation  files ",
    "mpl-2.0": " subject  to  the  terms  of  the  mozilla  public  license  v  2  0 ",
}


def _words(part: str) -> str:
    return f"(CASE WHEN {part} = '' THEN 0 ELSE (length({part}) - length(replace({part}, '  ', ''))) // 2 + 1 END)"


def _labels(found: list[str]) -> str:
    return f"array_to_string(list_sort([x FOR x IN [{', '.join(found)}] IF x IS NOT NULL]), ',')"


def license_sql() -> str:
    base = {k: f"contains(line, ' {p} ')" for k, (p, _) in _BASE.items()}
    own = {k: f"regexp_matches(line, '{p}')" for k, p in _TEMPLATES.items()}
    count = " + ".join(f"len(string_split(line, ' {p} ')) - 1" for p, _ in _BASE.values())
    first = ", ".join(f"CASE WHEN {base[k]} THEN {_words(f'''string_split(line, ' {p} ')[1]''')} END" for k, (p, _) in _BASE.items())
    last = ", ".join(f"CASE WHEN {base[k]} THEN n_words - {n} - {_words(f'''string_split(line, ' {p} ')[-1]''')} END"
                     for k, (p, n) in _BASE.items())
    named = lambda conditions: [f"CASE WHEN {c} THEN '{k}' END" for k, c in conditions.items()]
    any_of = lambda conditions: " OR ".join(conditions.values())
    return f"""WITH words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
        lines AS (SELECT doc_id, len(w)::BIGINT AS n_words,
                         CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS line FROM words)
        SELECT doc_id, n_words, ({count})::BIGINT AS n_base, least({first})::BIGINT AS first_word,
               greatest({last})::BIGINT AS last_word, {_labels(named(base))} AS base_labels,
               {_labels(named(base | own))} AS labels,
               CASE WHEN {any_of(own)} THEN 1.0 WHEN {any_of(base)} THEN 0.5 ELSE 0.0 END::DOUBLE AS score
        FROM lines"""
