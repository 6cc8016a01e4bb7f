"""Rules with look-around, which SQL cannot express, against plain Python over every order's notice and every document of the smallest tables."""

import regex

from noticeflow.functions import patterns as P
from noticeflow.plans import QUERIES
from noticeflow.plans.queries import GLOSSARY, notices

SF = "/root/testdata/sf0.001"


def rx(pattern):
    return regex.compile(pattern.replace(P.U, "", 1).replace(r"\z", r"\Z"), regex.V0)


RX = {k: rx(v) for k, v in vars(P).items() if isinstance(v, str) and k.isupper() and k != "U"}
LINE_END = regex.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]")


def cut(pattern, text):
    out, at = [], 0
    for m in pattern.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def long_parts(parts, more=3):
    return [p.strip() for p in parts if len(p.strip()) > more]


def sentences(text, plain=False, drop=True):
    lines = [x.strip() for x in cut(LINE_END, text) if x.strip()]
    if drop:
        lines = [x for x in lines if not RX["HEADING_LINE"].search(x) and not RX["NOISE_LINE"].search(x)]
    return [s for x in lines for s in long_parts(cut(RX["SENTENCE_CUT_PLAIN" if plain else "SENTENCE_CUT"], x))]


def by_mark(text):
    return [s.strip() for s in cut(RX["SENTENCE_END"], regex.sub(r"\s+", " ", text.replace("\0", " ")).strip()) if s.strip()]


def joined_lines(text):
    text = regex.sub("([^.!?\n])\n([^\n])", r"\1 \2", regex.sub(" ([가-힣])\n([가-힣])", r" \1\2", text))
    return regex.sub("[ \t]+", " ", text).strip()


def first_of(table, text, default):
    return next((name for name, words in table if any(w in text for w in words)), default)


def category(s):
    if RX["MONEY"].search(s):
        return "비용"
    dated = RX["DATE_ANY"].search(s) or RX["MONTH_ONLY"].search(s) or any(w in s for w in P.SCHEDULE_WORDS)
    return first_of(P.RULE_WORDS, s, "일정" if dated else P.OTHER)


def rejected(s):
    return len(s) < 7 or any(regex.search(p.replace(r"\z", r"\Z"), s) for p in P.NOT_TODO)


def due_date(s, year=2026):
    m = RX["DUE_ABSOLUTE"].search(s)
    if m:
        a, b = [int(x) for x in m.groups() if x]
        return f"{year}-{a:02d}-{b:02d}"
    m = RX["DUE_RELATIVE"].search(s)
    if m:
        return m[1].strip()
    m = RX["DUE_UNTIL"].search(s)
    return m[1].strip() if m and 0 < len(m[1].strip()) < 20 else None


def score(s):
    signs = [any(regex.search(p, s) for p, _ in P.ACTIONS), RX["DATE_ANY"].search(s), RX["MONEY"].search(s), "까지" in s, regex.search("주세요|바랍니다|십시오", s)]
    return min(0.25 + 0.18 * sum(map(bool, signs)), 0.99)


def easy(text):
    if text == "":
        return text
    kept = RX["EASY_KEPT"].findall(text)
    n = iter(range(len(kept)))
    text = RX["EASY_KEPT"].sub(lambda m: f"\ue000{next(n)}\ue001", text)
    near = P.EASY_LETTER[:-1] + "\ue000\ue001]"
    for word, other in P.EASY_WORDS:
        text = regex.sub(f"(?<!{near}){word}(?!{near})", other, text)
    body = text.strip()
    if body and not RX["POLITE_END"].search(body):
        mark = body[-1] if body[-1] in ".!?" else ""
        stem = body[:-1].rstrip() if mark else body
        for end, full in P.ENDINGS:
            if stem.endswith(end):
                text = stem[: len(stem) - len(end)] + full + mark
                break
    return regex.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else m[0], text)


def todos(text):
    out = []
    for pos, s in enumerate(sentences(joined_lines(text))):
        if not rejected(s) and score(s) >= 0.5:
            m = RX["AMOUNT_WON"].search(s)
            out.append({"pos": pos, "text": s, "due_date": due_date(s), "amount": int(m[1].replace(",", "")) if m else None, "confidence": round(score(s), 4), "action_hint": next((h for p, h in P.ACTIONS if regex.search(p, s)), None)})
    return out


def distinct(values):
    return list(dict.fromkeys(values))


def dates(text):
    """(surface, shown in Vietnamese)."""
    full = distinct(m[0] for m in RX["DATE_FULL"].finditer(text))
    seen, out = list(full), []
    some = []
    for m in RX["DATE_MONTH_DAY"].finditer(text):
        a, b = m.span()
        if m[0] not in seen and not any(text.find(s) <= a and b <= text.find(s) + len(s) for s in seen):
            seen.append(m[0])
            some.append(m[0])
    dotted = [x for x in distinct(m[0] for m in RX["DATE_DOTTED"].finditer(text)) if x not in seen]
    for surfaces, name, at in ((full, "DATE_FULL", (1, 2, 3, 4)), (some, "DATE_MONTH_DAY", (None, 1, 2, 3)), (dotted, "DATE_DOTTED", (1, 2, 3, 4))):
        for s in surfaces:
            m = RX[name].search(s)
            y, mo, d, w = (m[k] if k else None for k in at)
            shown = f"Ngày {int(d)}/{int(mo)}" + (f"/{int(y)}" if y else "") + (f" ({P.WEEKDAYS['vi'][w]})" if w else "")
            out.append((s, shown if int(mo) and int(d) else s))
    return out + [(w, P.RELATIVE["vi"].get(w, w)) for w in P.RELATIVE_DAYS if w in text]


def times(text):
    half = distinct(m[0] for m in RX["TIME_HALF_DAY"].finditer(text))
    clock = [x for x in distinct(m[0] for m in RX["TIME_24H"].finditer(text)) if x not in half]
    out = []
    for s in half:
        m = RX["TIME_HALF_DAY"].search(s)
        out.append((s, f"{int(m[2])} giờ" + (f" {int(m[3])}" if m[3] and int(m[3]) else "") + (" sáng" if m[1] == "오전" else " chiều")))
    for s in clock:
        h, minute = s.split(":")
        out.append((s, f"{int(h)} giờ" + (f" {int(minute)}" if int(minute) else "")))
    return out


def amounts(text):
    won = distinct(m[0] for m in RX["AMOUNT_WON"].finditer(text))
    unit = [x for x in distinct(m[0] for m in RX["AMOUNT_UNIT"].finditer(text)) if x not in won]
    value = [int(RX["AMOUNT_WON"].search(s)[1].replace(",", "")) for s in won] + [int(m[1]) * P.UNITS[m[2]] for m in map(RX["AMOUNT_UNIT"].search, unit)]
    return [(s, f"{v:,} won") for s, v in zip([*won, *unit], value, strict=True)]


def plain_slot(name, text):
    found = distinct(m[0].rstrip(".,)]") if name == "URL" else m[0] for m in RX[name].finditer(text))
    return [(s, s) for s in found]


def term(head):
    return next((v.strip() for k, v in GLOSSARY if k.strip() == head.strip() and v.strip()), head)


def headed(text):
    for h in sorted(P.HEADERS, key=lambda h: (-len(h), P.HEADERS.index(h))):
        m = regex.match(rf"(?s)\s*{regex.escape(h)}\s*[|:：]?\s*(.+)\Z", text.strip())
        if m:
            return h, m[1].strip()
    return None, text.strip()


def cards(text):
    """The eight cards of a notice: of its to-dos, then of slots that no header covers; values within longer ones go."""
    ranked = sorted(todos(text), key=lambda t: (-t["confidence"], t["pos"]))[:8]
    made = []
    for t in ranked:
        head, value = headed(t["text"])
        cat = category(value)
        made.append([head or P.OTHER, term(head or P.OTHER), value, easy(value), value, cat if cat != P.OTHER else None, t["confidence"]])
    heads = {c[0] for c in made}
    slots = {"dates": dates(text), "times": times(text), "urls": plain_slot("URL", text), "phones": plain_slot("PHONE", text), "amounts": amounts(text)}
    for slot, head in P.SLOT_HEADERS:
        if slots[slot] and not heads & set(P.SLOT_COVERED_BY[slot]):
            ko, shown = (", ".join(x[k] for x in slots[slot]) for k in (0, 1))
            made.append([head, term(head), ko, easy(ko), shown, None, 0.7])
    order = distinct(c[0] for c in made)
    kept = []
    norm = lambda v: regex.sub(r"[\s|｜:：]+", " ", v).strip()
    for c in sorted(made, key=lambda c: (order.index(c[0]), -len(c[2]))):
        if not any(k[0] == c[0] and norm(c[2]) in norm(k[2]) for k in kept):
            kept.append(c)
    return sorted(kept, key=lambda c: -c[6])[:8]


def texts(spark):
    return {r.notice_id: r.text for r in notices(spark, SF).collect()}


def test_sentence_counts(spark):
    got = {r.doc_id: (r.notice, r.plain, r.by_mark, r.simple) for r in QUERIES["doc_sentences_lookbehind"](spark, SF).collect()}
    simple = regex.compile(r"(?<=[.!?])\s+")
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = (len(sentences(r.text)), len(sentences(r.text, plain=True)), len(by_mark(r.text)), len(long_parts(cut(simple, r.text))))
        assert got[r.doc_id] == want, r.doc_id


def test_easy_korean(spark):
    got = {r.notice_id: r.easy for r in QUERIES["easy_korean"](spark, SF).collect()}
    assert got == {i: easy(t) for i, t in texts(spark).items()}


def test_todos(spark):
    got = {}
    for r in QUERIES["notice_todos"](spark, SF).collect():
        got.setdefault(r.notice_id, []).append({**r.asDict(), "confidence": round(r.confidence, 4)})
    for i, t in texts(spark).items():
        assert sorted(({k: v for k, v in x.items() if k != "notice_id"} for x in got.get(i, [])), key=lambda x: x["pos"]) == todos(t), t


def test_first_form(spark):
    got = {}
    for r in QUERIES["legacy_todos"](spark, SF).collect():
        got.setdefault(r.notice_id, []).append((r.pos, r.text, r.category, round(r.importance, 2), r.due_date))
    for i, t in texts(spark).items():
        want = []
        for pos, s in enumerate(sentences(t, plain=True, drop=False)):
            if rejected(s):
                continue
            cat, due = category(s), due_date(s)
            points = min(100, round(100 * P.BASE_IMPORTANCE.get(cat, 0.5)) + 5 * any(w in s for w in [*P.URGENT_WORDS, "신고"]))
            points = max(0, min(100, points + 5 * bool(due)) - 5 * (len(s) > 80))
            if points >= 25:
                want.append((pos, s if len(s) <= 100 else s[:97] + "...", cat, points / 100, due))
        assert sorted(got.get(i, [])) == want, t


def test_cards(spark):
    got = {}
    for r in QUERIES["notice_cards"](spark, SF).collect():
        got.setdefault(r.notice_id, []).append((r.pos, [r.header_ko, r.header_translated, r.value_ko, r.value_easy_ko, r.value_translated, r.chip, round(r.importance, 4)]))
    for i, t in texts(spark).items():
        assert [c for _, c in sorted(got.get(i, []), key=lambda x: x[0])] == [[*c[:6], round(c[6], 4)] for c in cards(t)], t


def test_analysis(spark):
    """Items and speech of every notice; English cards without a glossary."""
    import json

    texts_of = texts(spark)
    for r in QUERIES["notice_analysis"](spark, SF).collect():
        own = todos(texts_of[r.notice_id])
        items = json.loads(r.items)
        assert [(x["title_ko"], x.get("deadline"), x.get("amount"), x.get("action_hint"), round(x["importance"], 4)) for x in items] == [(t["text"], t["due_date"], f"{t['amount']:,}원" if t["amount"] is not None else None, t["action_hint"], t["confidence"]) for t in own]
        summary = json.loads(r.summary)
        assert [e["ko"] for e in summary["dates"]] == [s for s, _ in dates(texts_of[r.notice_id])] and [e["ko"] for e in summary["phones"]] == [s for s, _ in plain_slot("PHONE", texts_of[r.notice_id])]
        assert [e["ko"] for e in summary["deadlines"]] == distinct(t["due_date"] for t in own if t["due_date"])
        easy_lines = []
        for head, _, value, simple, *_ in cards(texts_of[r.notice_id]):
            said = RX["MARKERS"].sub("", simple or value)
            easy_lines.append(f"{head}. {said.strip()}" if head else said.strip())
        assert r.tts_text_easy_ko == "\n".join(easy_lines)
