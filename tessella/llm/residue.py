"""Problem 3: template residue, filler and error pages in place of an article.

A text is a case if every line of it is residue or a short site line, and at least one is residue. So each text
is read up to its first *open* line, one that is neither a site line nor residue by itself; a text without open lines
is decided, any other depends on that line first.

A line is residue by itself if placeholders, variable names, visible blanks or fill words (the defaults of templates) make up
most of it. Every other verdict comes from the records of the same template:

1. Lines are tokens: placeholders, defaults, codes, addresses and numbers are slots, runs of capitalised words one token, the rest
   words. Lines are aligned at anchors, pairs of their first or last words: for each anchor, the tokens at each distance
   are counted over all pages, and a token that more than half of them share is part of the template, anything else a slot.
2. Slots are looked at: a line of a template with more unfilled slots (placeholder, default where others have a value, blank where
   most have one) than filled ones is residue, whatever its length.
3. Whole-page templates: a page whose open lines all belong to templates of more than MOST_COPIES different pages
   (or that stands as it is under more than MOST_COPIES keys) is an error page or a notice; an article has no more copies.
4. A lexicon of notices in ten languages ranks what too few records share to induce a template: a short line that opens with a
   cue is residue with fewer pages, or none, behind it.

The other lines of texts whose first open line is residue are then looked at in the same way, in a second scan of those texts.
A text in which a line of prose stands is no case, whatever else it carries; quoted passages are taken out
before lines are looked at.

Null and blank texts are no cases. Repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.batches import sliced
from tessella.session import cut_lineage

# Phrases of error pages and notices, lower case.
NOTICES = """
page not found|not found|could not be found|cannot be found|can't be found|no longer available|page does not exist|doesn't exist|has been moved or deleted|backend fetch failed|guru meditation
bad gateway|service unavailable|gateway timeout|internal server error|temporarily unavailable|access denied|access to this|forbidden|do not have permission|don't have permission
something went wrong|try again later|too many requests|rate limit|slow down|uncaught typeerror|typeerror|referenceerror|cannot read property|is not defined|of undefined|fatal error|allowed memory size|stack trace|traceback (most recent|unhandled exception|syntax error|warning: |notice: undefined|database connection|failed to render|failed to load|expected field
enable javascript|javascript is disabled|javascript is required|requires javascript|turn on javascript|activate scripting|enable scripting|enable scripts|requires scripts|turn them on in your browser|noscript|please enable|browser is too old|browser is out of date|outdated browser|unsupported browser|browser is not supported|update your browser|upgrade your browser|checking your browser|verify you are human|are you a robot|not a robot|captcha|unusual traffic
we use cookies|uses cookies|accept all|accept cookies|enable cookies|cookies are disabled|cookie settings|cookie policy|consent string|manage choices|session has expired|has expired|session expired|session timed out|sign in again|log in again|please log in|please sign in|login required|subscribe to continue|subscribers only|moment please|please wait|loading...|redirecting|you are being redirected|ddos protection|ray id|incident id|if you are the owner of this site|is under maintenance|under construction|coming soon|domain is for sale
página no encontrada|no se encontró la página|no se ha encontrado|no existe la página|ya no existe|error del servidor|acceso denegado|no tiene permiso|active los scripts|active javascript|active el javascript|habilite javascript|activar javascript|habilitar javascript|utilizamos cookies|usamos cookies|aceptar todo|aceptar cookies|su sesión|la sesión ha|sesión ha caducado|sesión ha expirado|inicie sesión|navegador no|su navegador|actualice su navegador|algo salió mal|inténtelo de nuevo|intente de nuevo|demasiadas solicitudes|verifique que|estamos comprobando|comprobando su navegador
page introuvable|est introuvable|page n'existe|n'existe plus|a été déplacée|accès refusé|accès interdit|erreur du serveur|erreur 404|activez le script|activez les scripts|activez javascript|activer javascript|veuillez activer|nous utilisons des cookies|utilise des cookies|tout accepter|accepter les cookies|votre session|session a expiré|reconnectez-vous|votre navigateur|mettez à jour votre navigateur|navigateur est trop|une erreur est survenue|réessayez plus tard|trop de requêtes|vérification de votre navigateur
seite nicht gefunden|nicht gefunden|existiert nicht|zugriff verweigert|kein zugriff|keine berechtigung|serverfehler|schalten sie skripte|skripte ein|aktivieren sie javascript|javascript aktivieren|javascript ist deaktiviert|bitte aktivieren|wir verwenden cookies|wir nutzen cookies|alle akzeptieren|cookies akzeptieren|ihre sitzung|sitzung ist abgelaufen|melden sie sich|browser ist veraltet|ihr browser|etwas ist schiefgelaufen|versuchen sie es|zu viele anfragen|browser wird überprüft|einen moment bitte
página não encontrada|não foi localizado|não foi encontrad|não encontrad|não existe mais|acesso negado|sem permissão|erro do servidor|erro: o endereço|ative o javascript|ativar o javascript|habilite o javascript|ative os scripts|usamos cookies|utilizamos cookies|aceitar tudo|aceitar cookies|sua sessão|sessão expirou|entre novamente|seu navegador|atualize o navegador|algo deu errado|tente novamente|muitas solicitações|verificando seu navegador
не найдена|не найден|страница не|не существует|доступ запрещён|доступ запрещен|нет доступа|ошибка сервера|включите javascript|включите скрипты|включить скрипты|скрипты|javascript отключ|мы используем cookie|использует cookie|файлы cookie|принять все|сессия истекла|сеанс истёк|сеанс истек|войдите снова|ваш браузер|обновите браузер|браузер устарел|проверяем ваш браузер|проверка браузера|что-то пошло не так|попробуйте позже|слишком много запросов
見つかりません|ページが存在|存在しません|アクセスが拒否|アクセスできません|権限がありません|サーバーエラー|エラーが発生|スクリプトを有効|javascriptを有効|javascript を有効|クッキーを|cookieを|cookie を|すべて同意|セッションが|再度ログイン|もう一度ログイン|お使いのブラウザ|ブラウザを更新|ブラウザが古|ブラウザを確認|しばらくお待ち|後でもう一度|再読み込みして
找不到|页面不存在|未找到|无法找到|已被删除|拒绝访问|没有权限|无权访问|服务器错误|发生错误|启用脚本|启用javascript|启用 javascript|开启脚本|使用cookie|使用 cookie|接受所有|全部接受|会话已|登录已过期|重新登录|您的浏览器|更新浏览器|浏览器版本|正在检查|稍后再试|请求过多|请稍候|出错了
الصفحة غير موجودة|غير موجودة|لم يتم العثور|تعذر العثور|تم رفض الوصول|ليس لديك إذن|غير مصرح|خطأ في الخادم|حدث خطأ|تفعيل جافا|فعل جافا|تفعيل النصوص|تمكين البرامج النصية|جافا سكريبت|نستخدم ملفات تعريف|ملفات تعريف الارتباط|قبول الكل|انتهت الجلسة|انتهت صلاحية|سجل الدخول مرة|متصفحك|تحديث المتصفح|المتصفح قديم|جار التحقق|حاول مرة أخرى|طلبات كثيرة
पृष्ठ नहीं मिला|पेज नहीं मिला|नहीं मिला|नहीं मिली|उपलब्ध नहीं|अनुमति नहीं|प्रवेश निषेध|सर्वर त्रुटि|त्रुटि|स्क्रिप्ट चालू|स्क्रिप्ट सक्षम|जावास्क्रिप्ट|कुकी|कुकीज़|सभी स्वीकार|सत्र समाप्त|फिर से लॉग इन|दोबारा लॉग इन|आपका ब्राउज़र|ब्राउज़र अपडेट|ब्राउज़र पुराना|कुछ गलत|बाद में पुनः|पुनः प्रयास|बहुत अधिक अनुरोध|कृपया प्रतीक्षा
"""
# Status lines of servers at the start of a line.
STATUS_LINE = r"(?:http(?:/\d\.\d)? ?|error[: ]+|erreur[: ]+|fehler[: ]+|ошибка[: ]+|エラー[: ]*|错误[: ]*)?(?:40[0-9]|41[0-9]|429|50[0-9]|52[0-9])(?!\d)"
# Filler phrases and filler words.
FILLER = """
lorem ipsum|placeholder|do not publish|dummy text|sample text|filler text|your text here|text goes here|insert text|insert headline|headline here|body copy|to be written|test test|asdf|qwer|jkl|hjkl|tk tk|tktk|xxx xxx|foo bar|will appear here|edit this text|replace this
texto de ejemplo|texto de prueba|texto de relleno|texto aquí|sustituya este|reemplace este|texte d'exemple|texte de remplissage|texte à venir|texte ici|faux texte|remplacez ce|blindtext|beispieltext|platzhalter|hier steht|mustertext|ersetzen sie|texto de exemplo|texto fictício|substitua este|espaço reservado|текст-заполнитель|текст-рыба|пример текста|здесь будет|заглушка|замените этот
ダミーテキスト|サンプルテキスト|ここにテキスト|プレースホルダ|テスト テスト|示例文本|占位符|此处填写|测试测试|在此输入|نص تجريبي|نص بديل|نص مؤقت|ضع النص|نموذج نص|नमूना पाठ|परीक्षण पाठ|यहाँ पाठ|प्लेसहोल्डर
"""
FILLER_WORDS = frozenset((
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split())
KEYBOARD_WORDS = frozenset("asdf asdfg asdfgh qwer qwert qwerty jkl jklö hjkl zxcv yxcv uiop test tk xxx foo bar baz blah bla".split())
#: Syntax of unfilled placeholders, of any length within a line; none can run past the next opening, so a search takes linear time.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^{}\n]*%\}|[$#@]\{[^{}\n]*\}|<%[^<\n]*?%>|<\?[^<\n]*?\?>|%%[^%\n]+%%|\[\[[^\[\]\n]+\]\]|@@[^@\n]+@@"
    r"|__[A-Za-z](?:[A-Za-z0-9.\-]|_(?!_))++__|%\([A-Za-z_]\w*+\)[sd]|\{[A-Za-z_][\w.\-]*+\}|\[(?:INSERT|YOUR|TODO|TBD|PLACEHOLDER)[^\[\]\n]*\]|<<[A-Za-z_][\w .\-]*+>>"
)
#: What else stands for a value that isn't there: names of variables, visible blanks, bracketed names of fields.
VARIABLE = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b|_{3,}|\[ *\]|\[[A-Z][\w’']*(?: [A-Z][\w’']*)*\]"
_OPENINGS = ["{{", "{%", "${", "#{", "@{", "<%", "<?", "%%", "[[", "@@", "__", "%(", "{", "[insert", "[your", "[todo", "[tbd", "[placeholder", "<<"]
_QUOTED = re.compile(r"“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|»[^«\n]*«|「[^」\n]*」|『[^』\n]*』|《[^》\n]*》|\"[^\"\n]*\"")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-ःऺ-ॏ]+[^\W\d_]*)*|\d+")
_LETTER = re.compile(r"[^\W\d_]")
#: Values that a template puts where there is nothing to put.
DEFAULTS = frozenset("undefined null none nan nil untitled unnamed tbd".split())
_PATH = r"(?<!\w)/[\w\-./%]+|https?://\S+|\b[^\W\d_]+(?:[-_.][^\W\d_]+)+\b|\b[A-Z0-9]{6,}\b"
_TOKEN = re.compile(
    rf"(?P<open>{PLACEHOLDER.pattern}|{VARIABLE})|(?P<default>\[object Object\]|\((?:none|null|empty)\)|\b[nN]/[aA]\b)|(?P<code>{_PATH}|\b(?=[A-Z]*\d)[A-Z0-9]{{2,}}\b|\d+(?:[.:/\-]\d+)*)"
    r"|(?P<word>[^\W\d_]+(?:[̀-ͯऀ-ःऺ-ॏ'’]+[^\W\d_]*)*)"
)
_PATHS = re.compile(_PATH)
_STATUS = re.compile(STATUS_LINE)
_SENTENCE_END = re.compile(r"[.!?。！？।؟…][\"”»」』)\]]*\s*$")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
#: A line with more words than this is never a notice by its cue alone; a site line is shorter still.
NOTICE_WORDS = 24
SITE_WORDS = 12
#: Least share of a line's words that belong to its template, and least number of pages that make one.
TEMPLATE_SHARE = 0.5
TEMPLATE_SUPPORT = 3
#: An article is found under this many keys at most, and in as many versions; more pages of one template are a site's.
MOST_COPIES = 6
#: Least share of the words of a page's lines that belong to its template for the page to be one of a whole-page template.
WHOLE_SHARE = 0.75
_QUOTE = re.compile(r"[“„«»「『《\"]")
_EMPTY_SLOT = re.compile(rf"{PLACEHOLDER.pattern}|{VARIABLE}|\[object Object\]|\((?:none|null|empty)\)|\b[nN]/[aA]\b|\b(?i:{'|'.join(sorted(DEFAULTS))})\b")
#: No line longer than this has SITE_WORDS words or fewer unless they aren't words; only the verdict on site lines needs its size.
SITE_CHARS = 400
_SENTENCE_SIGNS = ".!?:;…"
#: Kinds of tokens, in the three low bits of their numbers.
WORD, OPEN, DEFAULT, CODE, NAME = range(5)


def _phrases(text: str) -> list[str]:
    return [p for p in text.replace("\n", "|").split("|") if p.strip()]


@lru_cache(maxsize=1)
def _automata():
    """One automaton over every cue, for whole texts, and one over the phrases alone."""
    import ahocorasick

    whole, phrases = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in dict.fromkeys(_phrases(NOTICES)):
        phrases.add_word(phrase, ("notice", phrase))
        whole.add_word(phrase, 1)
    for phrase in dict.fromkeys(_phrases(FILLER)):
        phrases.add_word(phrase, ("filler", phrase))
        whole.add_word(phrase, 1)
    for opening in _OPENINGS:
        whole.add_word(opening, 1)
    for word in ("lorem", "ipsum", "ullamco", "cillum", "pariatur", "consequat", *(str(n) for n in [*range(400, 418), 429, *range(500, 512), *range(520, 528)])):
        whole.add_word(word, 1)
    whole.make_automaton()
    phrases.make_automaton()
    return whole, phrases


def has_cue(text: str) -> bool:
    return next(_automata()[0].iter(text.lower()), None) is not None


def _size(line: str, words: list[str]) -> float:
    """Words of a line; two and a half signs of a script without blanks count as one."""
    wide = len(_WIDE.findall(line))
    return len(words) if not wide else len([w for w in words if not _WIDE.search(w)]) + wide / 2.5


def line_tokens(line: str) -> list[int]:
    """A number for each token of a line: a hash of it, and its kind in the three low bits. Quoted passages aren't looked at.

    Names are runs of capitalised words, one token each; a capitalised word that stands alone at the start of the line or of a sentence is a word.
    """
    bare = _QUOTED.sub(" ", line) if _QUOTE.search(line) else line
    out: list[int] = []
    run: list[str] = []
    last, starts = 0, True

    def close() -> None:
        kind = WORD if len(run) == 1 and starts else NAME
        out.append(crc32(" ".join(run).lower().encode("utf-8", "replace")) & 0x7FFFFFF8 | kind)
        run.clear()

    for m in _TOKEN.finditer(bare):
        unit, group = m.group(), m.lastgroup
        if group == "word" and unit[0].isupper():
            between = bare[last : m.start()].strip()
            if run and between:
                close()
            if not run:
                starts = not out or between[-1:] in _SENTENCE_SIGNS and between != ""
            last = m.end()
            if unit.lower() not in DEFAULTS:
                run.append(unit)
                continue
        if run:
            close()
        last = m.end()
        low = unit.lower()
        kind = WORD if group == "word" else OPEN if group == "open" else CODE if group == "code" else DEFAULT
        out.append(crc32(low.encode("utf-8", "replace")) & 0x7FFFFFF8 | (DEFAULT if low in DEFAULTS else kind))
    if run:
        close()
    return out


def _hash(key: str) -> int:
    return int.from_bytes(blake2b(key.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def line_anchors(parts: list[str], count: int) -> tuple[list[int], int | None]:
    """Hashes under which a line may stand with others of its template: its anchors, and its shape.

    Anchors are pairs of words, the first two, the first and the third, the last two, each with the line's ``count`` of words or tokens, so that
    equal places are equal distances. The shape is all its words in their order, whatever stands in the slots between them. Words are those in lower case.
    """
    words = [w for w in parts if (w.isalpha() or not w.isascii() and _WORD.fullmatch(w)) and w == w.lower() and w not in DEFAULTS]
    if len(words) < 2:
        return ([_hash(f"f {count} {words[0]}")] if words else []), None
    pairs = {f"a {count} {words[0]} {words[1]}", f"b {count} {words[0]} {words[min(2, len(words) - 1)]}", f"c {count} {words[-1]} {words[-2]}"}
    return [_hash(k) for k in pairs], _hash(" ".join(words))


def describe_line(line: str) -> dict:
    """What a line shows by itself: its size in words, its kind as far as it is certain, and whether it opens with a cue.

    Kinds: ``residue`` by its placeholders and fill words, ``notice`` by the lexicon alone, ``cue`` for a line with one cue, else ``other``.
    """
    bare = _QUOTED.sub(" ", line)
    slots = PLACEHOLDER.findall(bare)
    rest = PLACEHOLDER.sub(" ", bare) if slots else bare
    plain = _PATHS.sub(" ", rest)
    words = [w.lower() for w in _WORD.findall(plain)]
    letters = [w for w in words if _LETTER.match(w)]
    size = _size(plain, letters)
    out = {"size": size, "kind": "other", "opens": False}
    if slots and size <= 4 * len(slots) + 1:
        return out | {"kind": "residue"}
    if len(letters) >= 3 and sum(w in FILLER_WORDS for w in letters) >= 0.7 * len(letters) and any(w in ("lorem", "ipsum", "dolor", "amet", "nulla", "magna", "labore", "ullamco", "elit", "aliqua") for w in letters):
        return out | {"kind": "residue"}
    if letters and sum(w in KEYBOARD_WORDS for w in letters) >= 0.6 * len(letters) and len(letters) >= 2:
        return out | {"kind": "residue"}
    low = rest.lower()
    hits = [(end - len(phrase) + 1, -len(phrase), kind, phrase) for end, (kind, phrase) in _automata()[1].iter(low)]
    # a phrase of words has to start and end at the border of words
    hits = [h for h in hits if _at_border(low, h[0], h[0] - h[1])]
    status = _STATUS.match(low.strip())
    if status and not hits:
        hits = [(low.index(low.strip()), -len(status.group()), "notice", status.group())]
    if hits:
        start, negative, kind, phrase = min(hits)
        before = _WORD.findall(_PATHS.sub(" ", rest[:start]))
        out |= {"kind": "cue", "opens": len(before) <= 6}
        # phrases inside of others don't count again
        covered = sum(not any(o[0] <= h[0] and o[0] - o[1] >= h[0] - h[1] and o != h for o in hits) for h in hits)
        if status and size <= NOTICE_WORDS or kind == "filler" and size <= NOTICE_WORDS / 2 or covered >= 2 and size <= NOTICE_WORDS:
            out["kind"] = "notice"
    return out


def _line_size(line: str) -> float:
    """Words of a line without any cue; of one with clearly more than a site line has, a lower bound."""
    least = sum(map(str.isalpha, line.split()))
    if least > SITE_WORDS:
        return least
    return _size(line, [w for w in _WORD.findall(_PATHS.sub(" ", line)) if _LETTER.match(w)])


def _at_border(text: str, start: int, end: int) -> bool:
    if _WIDE.search(text[start:end]):
        return True
    before, after = text[start - 1 : start], text[end : end + 1]
    return not (_LETTER.match(text[start]) and before and _LETTER.match(before)) and not (_LETTER.match(text[end - 1]) and after and _LETTER.match(after))


def is_site_line(line: str, size: float) -> bool:
    """Short, and no sentence: bylines, share prompts, dates, notices of rights."""
    if "©" in line or "(c)" in line.lower():
        return size <= SITE_WORDS
    return size <= SITE_WORDS and not _SENTENCE_END.search(line.strip())


_FIRST_SCHEMA = "doc {kind}, page bigint, line_no int, flagged boolean, anchors array<bigint>, shape bigint, words array<int>"
_SCHEMA = "page bigint, line_no int, kind string, opens boolean, size float, site boolean, tokens array<int>, anchors array<bigint>, shape bigint"


def open_lines(text: str) -> Iterator[tuple[int, str, dict, bool]]:
    """The lines that are neither plain site lines nor residue by themselves: number, line, what it shows and whether it is a site line with a cue or an empty slot.

    A text of nothing but plain site lines has these as open lines, longest first. Afterwards, if there was any residue, one more with the number -1.
    """
    residue, opened, plain = False, False, []
    for number, line in enumerate(text.split("\n")):
        if not line.strip():
            continue
        shown = describe_line(line) if has_cue(line) else None
        if shown and shown["kind"] == "residue":
            residue = True
            continue
        size = shown["size"] if shown else _line_size(line)
        site = is_site_line(line, size)
        if shown and shown["kind"] != "other" or not site or _EMPTY_SLOT.search(line):
            opened = True
            yield number, line, shown or {"size": size, "kind": "other", "opens": False}, site
        elif not opened and not residue:
            plain.append((-len(line), number, line, size))
    if residue:
        yield -1, "", {"size": 0.0, "kind": "residue", "opens": False}, True
    elif not opened:
        for _, number, line, size in sorted(plain):
            yield number, line, {"size": size, "kind": "other", "opens": False}, True


def _word_hash(word: str) -> int:
    """31 bits, of which the lowest tells a capitalised word."""
    return crc32(word.encode("utf-8", "replace")) & 0x7FFFFFFE | (word[0].isupper() and not word.isupper())


def _first_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()))
    for batch in sliced(batches):
        rows, out = [], [[] for _ in types]
        for row, text in enumerate(batch.column(2).to_pylist()):
            for number, line, shown, site in open_lines(text):
                parts = line.split()
                flagged = shown["kind"] != "other" or _EMPTY_SLOT.search(line) is not None
                rows.append(row)
                for held, value in zip(out, (number, flagged, *line_anchors(parts, len(parts)), [_word_hash(w) for w in parts])):
                    held.append(value)
                break
        if rows:
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), *[pa.array(v, t) for v, t in zip(out, types)]], names=["doc", "page", "line_no", "flagged", "anchors", "shape", "words"]
            )


def _line_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.string(), pa.bool_(), pa.float32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64())
    for batch in sliced(batches):
        rows, out = [], [[] for _ in types]
        for row, text in enumerate(batch.column(1).to_pylist()):
            for number, line, shown, site in open_lines(text):
                tokens = line_tokens(line)
                rows.append(row)
                for held, value in zip(out, (number, shown["kind"], shown["opens"], shown["size"], site, tokens, *line_anchors(line.split(), len(tokens)))):
                    held.append(value)
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *[pa.array(v, t) for v, t in zip(out, types)]], names=["page", "line_no", "kind", "opens", "size", "site", "tokens", "anchors", "shape"])


def _pages(documents: DataFrame, key: str, text: str) -> DataFrame:
    slim = documents.select(F.col(key).alias("doc"), F.xxhash64(F.col(text), F.length(text)).alias("page"), F.col(text).alias("text"))
    return slim.where("doc is not null and text is not null")


def first_lines(pages: DataFrame) -> DataFrame:
    """``doc, page, line_no, flagged, anchors, shape, words`` of the first open line of each text of ``doc, page, text``."""
    return pages.mapInArrow(_first_mapper, _FIRST_SCHEMA.format(kind=pages.schema["doc"].dataType.simpleString()))


def _majority(words: DataFrame, name: str) -> DataFrame:
    """``anchor, template, fixed`` of ``anchor, n, place, <name>``: the word that more than half of the n pages have at each place, null in a slot, and their number."""
    common = words.groupBy("anchor", "n", "place", name).agg(F.count("*").alias("k")).where(F.col("k") > 0.5 * F.col("n"))
    held = common.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", name))).alias("m"))
    places = F.sequence(F.lit(0), F.array_max(F.map_keys("m")))
    return held.select("anchor", F.transform(places, lambda i: F.element_at("m", i)).alias("template"), F.size("m").alias("fixed"))


def pages_to_read(first: DataFrame) -> DataFrame:
    """``page`` of the texts whose first open line can be residue: it has a cue or an empty slot, or the shape of others, or most of its words belong to a template.

    Each line is aligned under the rarest of its anchors that others share; their words are counted by place.
    """
    lines = first.where("line_no >= 0").select("page", "flagged", "anchors", "shape", "words")
    held = lines.select("page", F.explode("anchors").alias("anchor"))
    support = held.groupBy("anchor").agg(F.count_distinct("page").alias("n")).where(F.col("n") > MOST_COPIES)
    chosen = held.join(support, "anchor").groupBy("page").agg(F.min(F.struct("n", "anchor")).alias("x")).select("page", F.col("x.anchor").alias("anchor"))
    groups = chosen.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MOST_COPIES)
    grouped = cut_lineage(lines.select("page", "words").join(chosen, "page").dropDuplicates(["page"]).join(groups, "anchor"))
    common = _majority(grouped.select("anchor", "n", F.posexplode("words").alias("place", "word")), "word")
    other = F.filter(F.zip_with("words", "template", lambda w, t: F.when(w.isNotNull() & ~F.coalesce(w == t, F.lit(False)), w)), lambda w: w.isNotNull())
    alike = grouped.join(common.where(F.col("fixed") >= TEMPLATE_SHARE / 2 * F.size("template")), "anchor").where(
        (F.size(other) <= (1 - TEMPLATE_SHARE) * F.size("words")) & ~F.exists(other, lambda w: w.bitwiseAND(F.lit(1)) == 1)
    )
    each = lines.where("shape is not null").select("page", "shape", "flagged", F.size("words").alias("size"))
    shapes = each.groupBy("shape").agg(F.count_distinct("page").alias("n"), F.max("flagged").alias("flagged"), F.min("size").alias("least"), F.max("size").alias("most"))
    varying = shapes.where((F.col("n") >= TEMPLATE_SUPPORT) & (F.col("flagged") | (F.col("least") < F.col("most")))).select("shape")
    return alike.select("page").union(each.join(varying, "shape", "left_semi").select("page")).union(lines.where("flagged").select("page")).distinct()


def described_lines(pages: DataFrame) -> DataFrame:
    """All open lines of each text of ``page, text``, with tokens, anchors and shape."""
    return pages.select("page", "text").mapInArrow(_line_mapper, _SCHEMA)


def _kind(token: Column) -> Column:
    return token.bitwiseAND(F.lit(7))


def templates(lines: DataFrame) -> DataFrame:
    """Aligned templates ``anchor, support, template, fixed``: the tokens that most pages with this anchor have at each place, null in a slot."""
    held = lines.select("page", "line_no", F.explode("anchors").alias("anchor"))
    supported = held.groupBy("anchor").agg(F.count_distinct("page").alias("support")).where(F.col("support") >= TEMPLATE_SUPPORT)
    # a page counts once for an anchor, with its first line
    once = held.join(supported, "anchor").groupBy("anchor", "support", "page").agg(F.min("line_no").alias("line_no"))
    tokens = once.join(lines.select("page", "line_no", "tokens"), ["page", "line_no"]).select("anchor", F.col("support").alias("n"), F.posexplode("tokens").alias("place", "token"))
    return _majority(tokens, "token").join(supported, "anchor")


def _slot_counts(lines: DataFrame) -> DataFrame:
    """``shape, pages, values, usual`` of the shapes that several pages have: how many of them have no default, and how many slots most of them have."""
    slots = F.size(F.filter("tokens", lambda t: _kind(t) != WORD))
    default = F.exists("tokens", lambda t: _kind(t).isin(OPEN, DEFAULT))
    each = lines.where("shape is not null").groupBy("shape", "page").agg(F.max(slots).alias("slots"), F.min(default).alias("default"))
    by_count = each.groupBy("shape", "slots").agg(F.count("*").alias("n"), F.sum((~F.col("default")).cast("int")).alias("values"))
    # shapes are few tokens each, and their counts of slots fewer
    running = Window.partitionBy("shape").orderBy(F.desc("slots"))
    ranked = by_count.withColumn("upto", F.sum("n").over(running)).withColumn("pages", F.sum("n").over(Window.partitionBy("shape")))
    return ranked.groupBy("shape").agg(
        F.max("pages").alias("pages"), F.sum("values").alias("values"), F.max(F.when(F.col("upto") > 0.5 * F.col("pages"), F.col("slots"))).alias("usual")
    ).where(F.col("pages") >= TEMPLATE_SUPPORT)


def judged_lines(lines: DataFrame, *, lexicon: bool = True) -> DataFrame:
    """``page, line_no, residue, site``: the lines after templates are induced and their slots looked at. ``copied``: the page stands under many keys."""
    lines = lines.where("line_no >= 0")
    aligned = lines.select("page", "line_no", "tokens", F.explode("anchors").alias("anchor")).join(templates(lines), "anchor")

    def counted(fixed: bool, *kinds: int) -> Column:
        """How many tokens of these kinds are the template's, or aren't."""
        return F.size(F.filter(F.zip_with("tokens", "template", lambda t, f: _kind(t).isin(*kinds) & (F.coalesce(t == f, F.lit(False)) == fixed)), lambda x: x))

    fixed = counted(True, WORD, NAME)
    best = aligned.select("page", "line_no", F.struct((fixed / F.greatest(fixed + counted(False, WORD, NAME), F.lit(1))).alias("share"), "support", (-counted(False, CODE, NAME)).alias("values"), (-counted(False, CODE)).alias("codes"), (-counted(False, NAME)).alias("names")).alias("m"))
    joined = lines.join(best.groupBy("page", "line_no").agg(F.max("m").alias("m")), ["page", "line_no"], "left").join(_slot_counts(lines), "shape", "left")
    count = lambda *kinds: F.size(F.filter("tokens", lambda t: _kind(t).isin(*kinds)))
    share, support = F.coalesce("m.share", F.lit(0.0)), F.coalesce("m.support", F.lit(0))
    named = F.coalesce(-F.col("m.values"), count(CODE, NAME))
    blank = F.greatest(F.col("usual") - count(OPEN, DEFAULT, CODE, NAME), F.lit(0))
    unfilled = count(OPEN) + F.when(F.col("values") > 0, count(DEFAULT)).otherwise(0) + blank
    slots = (F.col("usual").isNotNull() | F.col("copied")) & (unfilled > named)
    # what names people is an article's, however often it comes back; so is what has no slot for a code, an address or a number
    unnamed = count(NAME) == 0
    varying = F.coalesce((F.col("m.codes") < 0) & (F.col("m.names") == 0), F.lit(False)) | unnamed & (count(OPEN, DEFAULT) > 0)
    whole = (support > MOST_COPIES) & (share >= WHOLE_SHARE) & varying & (~F.col("site") | (F.col("kind") != "other") | (count(OPEN) > 0))
    residue = slots | whole | F.col("copied") & (count(OPEN, DEFAULT, CODE) > 0) & unnamed
    if lexicon:
        induced = (support >= TEMPLATE_SUPPORT) & (share >= TEMPLATE_SHARE)
        short = F.col("size") <= F.when(induced, NOTICE_WORDS).otherwise(SITE_WORDS + 2)
        residue = residue | (F.col("kind") == "notice") | ((F.col("kind") == "cue") & F.col("opens") & (short | induced & (count(NAME) == 0)))
    return joined.select("page", "line_no", F.coalesce(residue, F.lit(False)).alias("residue"), "site")


def residue_documents(documents: DataFrame, *, key: str, text: str, lexicon: bool = True) -> DataFrame:
    """Keys of the texts that hold residue and no article. Without the lexicon, templates and slots decide alone."""
    pages = _pages(documents, key, text)
    first = cut_lineage(first_lines(pages))
    sure = first.where("line_no < 0").select("page")
    keys = first.where("line_no >= 0").select("page", "doc").distinct().groupBy("page").agg(F.count("*").alias("keys"))
    copied = keys.where(F.col("keys") > MOST_COPIES).select("page", F.lit(True).alias("copied"))
    # only these can be residue; their texts are read again, whole
    wanted = cut_lineage(pages_to_read(first).join(copied, "page", "full").select("page", F.coalesce("copied", F.lit(False)).alias("copied")))
    lines = cut_lineage(described_lines(pages.join(wanted, "page", "left_semi").dropDuplicates(["page"])).join(wanted, "page"))
    own = lines.where("line_no < 0").select("page", F.lit(True).alias("residue"), F.lit(True).alias("site"))
    verdict = judged_lines(lines, lexicon=lexicon).select("page", "residue", "site").unionByName(own).groupBy("page").agg(
        F.max("residue").alias("some"), F.min(F.col("residue") | F.col("site")).alias("all")
    )
    found = verdict.where(F.col("some") & F.col("all")).select("page").union(sure)
    return first.join(found, "page", "left_semi").select(F.col("doc").alias(key)).distinct()


def without_residue(documents: DataFrame, *, key: str, text: str) -> DataFrame:
    """The rows whose text is an article, or that have none."""
    return documents.join(residue_documents(documents, key=key, text=text), key, "left_anti")
