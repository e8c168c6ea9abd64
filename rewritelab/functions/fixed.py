"""Word lists, patterns and weights that results depend on."""

STOP_WORDS = (
    "a an the and or but if then than so of to in on at by for from with without into onto over under about as is are was were be been being am "
    "do does did done have has had having i you he she it we they me him her us them my your his its our their this that these those there here who whom which what when where why how "
    "very just also too own can could will would shall should may might must need dare up down out off again further once "
    "because while until although though whether either neither"
).split()

ABBREVIATIONS = frozenset("dr mr mrs ms prof sr jr st vs etc e.g i.e fig figs no vol inc ltd co corp jan feb mar apr jun jul aug sep sept oct nov dec u.s u.k ph.d approx dept univ al eq ref refs cf ca pp p".split())

CJK = "[㐀-䶿一-鿿豈-﫿]"
CLOSERS = "\"'”’)]』」》"
LIST_ITEM = r"^\s*(?:[-*•·▪]|\d{1,3}[.)、:：]|[a-zA-Z][.)]|[①-⑩]|\(\d{1,3}\)|#+\s)"
NUMBER_LIKE = r".*\d.*|fig|figs|eq|ref|refs|table|tbl|s\d*|[ivx]{1,4}"
FACT = r"[\w.+-]+@[\w-]+\.[\w.-]+|https?://\S+|www\.\S+|\d+(?:[.,:/-]\d+)*%?|\b[A-Z][A-Z0-9]{1,}\b"
BLOCK_TAG = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|blockquote)\b[^>]*>"
ANY_TAG = r"<[^<>]{1,60}>"

FORMAT_LINE = (
    r"^\s*(?:(?:subject|re|fw|fwd|to|from|cc|date|title)\s*[:：]|(?:dear|hi|hello|hey|good (?:morning|afternoon|evening))\b|"
    r"(?:best|best regards|best wishes|regards|kind regards|warm regards|warmly|sincerely|sincerely yours|cheers|thanks|thank you|many thanks|thanks again|yours|yours truly|respectfully|take care|talk soon|all the best)\s*[,!.]?\s*$|"
    r"#{1,6}\s|(?:尊敬的|亲爱的|各位|敬爱的)|[^\s,，:：]{1,12}(?:老师|教授|同学|先生|女士|经理|总|博士|主任|导师)[:：,，]?\s*$|"
    r"(?:此致|敬礼|祝好|祝安|祝|顺祝|顺颂|谢谢|感谢|敬上|谨上|学生|申请人|您好)[:：!！。,，]?\s*$)"
)
SIGNATURE = r"[\w.+-]+@[\w-]+\.[\w.-]+|\d{4}[-/年.]\d{1,2}([-/月.]\d{1,2}日?)?|^\s*[—–]{1,2}\s*\S"
FENCE = r"^\s*(?:```|~~~)"
RULE_LINE = r"^\s*(?:[-*_]\s*){3,}$"
FIELD = r"^\s*[A-Za-z][A-Za-z /_-]{0,20}\s*[:：]\s*\S"
END_MARK = "[.!?。!?…][\"'”’)\\]]?\\s*$"
SOFT_WRAP_STOP = "[.!?:;。！？；：…][\"'”’)\\]]*\\s*$"
DATA = r"\d|@|https?://|www\.|\.(?:com|org|net|io|edu|gov|cn)\b|[/\\]|[—–|·]\s*\S+\s*[—–|·]"
SIGN_OFF = (
    r"^\s*(?:best|best regards|best wishes|regards|kind regards|warm regards|warmly|sincerely|sincerely yours|cheers|thanks|thanks again|thank you|many thanks|yours|yours truly|"
    r"respectfully|take care|talk soon|all the best|thanks so much|thanks a lot|warm wishes|gratefully|with appreciation|much appreciated|appreciate it|with thanks|best of luck)\s*[,!.]?\s*$"
    r"|^\s*(?:此致|敬礼|祝好|祝安|顺祝|顺颂|敬上|谨上)[:：!！。,,]?\s*$"
)
GREETING = r"^\s*(?:dear|hi|hello|hey|good (?:morning|afternoon|evening))\b|^\s*(?:尊敬的|亲爱的|各位|敬爱的)|^[^\s,,::]{1,12}(?:老师|教授|同学|先生|女士|经理|总|博士|主任|导师)[:：,,]?\s*$"
LINE_KINDS = (
    ("subject", r"(?i)^\s*(?:subject|re|fw|fwd|to|from|cc|date|主题|收件人|发件人)\s*[:：]"),
    ("title", r"^\s*#{1,6}\s"),
    ("greeting", r"(?i)^\s*(?:dear|hi|hello|hey|good (?:morning|afternoon|evening)|尊敬的|亲爱的|各位|敬爱的)\b"),
    ("greeting", r"^[^\s,，:：]{1,12}(?:老师|教授|同学|先生|女士|经理|总|博士|主任|导师|您好)[:：,，]?\s*$"),
    ("signoff", r"(?i)^\s*(?:best regards|best wishes|best|sincerely(?: yours)?|kind regards|warm regards|warmly|regards|cheers|many thanks|thanks again|thanks|thank you|yours(?: truly)?|respectfully|take care|talk soon|all the best)\s*[,!.]?\s*$"),
    ("signoff", r"^\s*(?:此致|敬礼|祝好|祝安|顺祝|顺颂|谢谢|感谢|敬上|谨上|学生|申请人)[:：!！。,，]?\s*$"),
)

INSTRUCTION = """Rewrite the text below so it reads like a person wrote it, not a language model.

Reorganize it as you see fit. Vary sentence length on purpose. Cut hedging,
throat-clearing, and any sentence that only announces what comes next.
Prefer the concrete word over the abstract one. It is fine to sound uneven.

Every fact, number, unit, date, name and quotation must survive unchanged."""
SEPARATOR = "\n\n### Rewritten:\n\n"
STOP_STRINGS = ("\n### Rewritten:", "\n\n\n\n")

#: Reward weights.
JUDGE_FAILED = -1.0
HARD_FAIL, COPY_SKIP, REUSE_FREE, COPY_POWER = -8.0, 0.85, 0.31, 1.61
W_CRITICAL, W_MINOR, W_INVENTED, W_REVERSED, W_REGISTER, W_FORMAT, W_GREETING = 3.0, 0.15, 2.0, 2.0, 1.0, 1.5, 1.5
STYLE_ALIASES = {"daily_email": "email_short", "daily_paper": "paper_bio", "academic_en": "paper_clean", "daily_report": "report_crs", "daily_essay": "essay_student", "daily_reddit": "reddit_post", "daily_linkedin": "blog_personal"}
