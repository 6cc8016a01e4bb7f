"""Patterns, word lists and tables that results depend on, in Java regex syntax."""

U = "(?U)"  # Unicode classes, as the texts need for blanks and letters
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # what \s is with Unicode classes
# A pattern is tried at every character: what the first character must be comes before any look at its neighbours.

# dates, times, amounts, links, phones, deadlines
DATE_FULL = U + r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일(?:\s*\(([월화수목금토일])\))?"
DATE_MONTH_DAY = U + r"(\d{1,2})\s*월\s*(\d{1,2})\s*일(?:\s*\(([월화수목금토일])\))?"
DATE_DOTTED = U + r"(?:(\d{4})\s*\.\s*)?(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*\(([월화수목금토일])\)"
RELATIVE_DAYS = ["내일", "모레", "오늘", "다음 주", "다음주", "이번 주", "이번주"]
RELATIVE_SIGNS = ["내일", "모레", "오늘", "다음", "이번"]  # each of them has one
NUMBERS, WEEKDAY_END = U + r"\d+", U + r"\(([월화수목금토일])\)\z"  # of a date's surface
TIME_HALF_DAY = U + r"(오전|오후)\s*(\d{1,2})\s*시(?:\s*(\d{1,2})\s*분)?"
TIME_24H = U + r"(?=\d)(?<!\d)(\d{1,2}):(\d{2})(?!\d)"
AMOUNT_WON = U + r"(\d{1,3}(?:,\d{3})+|\d+)\s*원"
AMOUNT_UNIT = U + r"(\d+)\s*(만|천|억)\s*원"
UNITS = {"천": 1_000, "만": 10_000, "억": 100_000_000}
URL = U + r"""(?i)h(?<=\bh)ttps?://[^\s<>"'()]+|w(?<=\bw)ww\.[^\s<>"'()]+"""
PHONE = U + r"(?=\d)(?<![\d-])(?:\d{2,4}-\d{3,4}-\d{4}|\d{4}-\d{4}|\d{3,4}-\d{4})(?!\d)"
DEADLINE, DEADLINE_CUT = "까지", "[.\n❍❏|※]"
MARKERS = U + r"^[\s■▶▸◆●○*\-•]+"
SUPPLY_LABEL = U + r"준비물\s*[:：]?\s*"
SUPPLY_TAIL = U + r"(을|를)?\s*(준비해|챙겨|가져)[^\n]*\z"
SUPPLY_CUT = U + r"[,，、]\s*|\s*(?:과|와|및)\s+"

# to-dos
DUE_ABSOLUTE = U + r"(?:(\d{1,2})\s*월\s*(\d{1,2})\s*일)|(?=\d)(?<![\d.])(?<!mm)(?<!cm)(?<!원)(?<!시)(\d{1,2})[./](\d{1,2})(?!\d)(?![mc]m)(?!kg)"
DUE_PARTS = U + r"\A(\d{1,2})\D+(\d{1,2})"  # of what DUE_ABSOLUTE found
DUE_RELATIVE = U + r"(다음\s*주\s*[월화수목금토일]요일|이번\s*주\s*[월화수목금토일]요일|매주\s*[월화수목금토일]요일|오늘|내일|모레)"
DUE_UNTIL = U + r"(?<![\w가-힣\s])([\w가-힣\s]+?)\s*까지"  # from where a run of letters and blanks starts, which is where the first one always starts
ACTIONS = [("납부|입금", "납부"), ("제출", "제출"), ("신청", "신청"), ("참여|참가|출석", "참여"), ("준비|지참|챙겨", "준비"), ("확인|숙지|참고", "확인")]
HEADING_LINE = U + r"^[^.,!?~]{2,40}(안내|공지|알림|공개수업|상담|학습|행사|일정)\s*\z"
NOISE_LINE = U + r"^https?://|^www\.|^☎\s*\d|^\d{1,2}:\d{2}\s*[~\-–]\s*\d{1,2}:\d{2}\s*\z|^[→←↑↓]+\s*\z"
_MARKED = r"\d+[.)]\s|[가-힣]\.\s"
_LABELS = r"[❏○◆●▪◎□■]|운영시간|운영방법|신청방법|신청기간|준비물|제출|기타\s*안내|접수방법|참가방법"
# blanks after a closing mark, and those before a list mark or a label
SENTENCE_CUT = U + rf"\s(?:(?<=[.!?]\s)\s*+|\s*+(?={_MARKED}|{_LABELS}))"
SENTENCE_CUT_PLAIN = U + rf"\s(?:(?<=[.!?]\s)\s*+|\s*+(?={_MARKED}))"
SENTENCE_CUT_SIMPLE = U + r"\s(?<=[.!?]\s)\s*+"
NOT_TODO = [
    r"^학부모님\s*안녕하십니까",
    r"^안녕하십니까",
    r"^학부모님\s*안녕하세요",
    r"^안녕하세요",
    r"^.*님\s*안녕하(세요|십니까)",
    r"^학부모님께\s*안내드립니다",
    r"^학부모님께\s*드립니다",
    r"안내드립니다\s*\.?\s*\z",
    r"드립니다\s*\.?\s*\z",
    r"^[^.,!?]{1,30}\s*안내\s*\z",
    r"교장\z",
    r"^\d{4}\.\s*\d{1,2}\.\s*\d{1,2}\.?\s*\z",
    r"담당\s*[:：]",
    r"^\(.\s*\d{4}-\d{4}",
    r"^08\d{3}\s*서울특별시",
    r"공익제보센터",
    r"자살예방상담",
    r"청소년상담",
]

NOT_TODO_LEGACY = [
    r"^학부모님\s*안녕하십니까",
    r"^안녕하십니까",
    r"^학부모님께\s*안내드립니다",
    r"^학부모님께\s*드립니다",
    r"안내드립니다\s*\.?\s*\z",
    r"드립니다\s*\.?\s*\z",
    r"^[^.,!?]{1,30}\s*안내\s*\z",
    r"교장\z",
    r"^\d{4}\.\s*\d{1,2}\.\s*\d{1,2}\.?\s*\z",
    r"담당\s*[:：]",
    r"^\(.\s*\d{4}-\d{4}",
    r"^08\d{3}\s*서울특별시",
    r"공익제보센터",
    r"자살예방상담",
    r"청소년상담",
]
NOISE_LINE_ANYWHERE = U + r"https?://|^www\.|☎\s*\d|^\d{1,2}:\d{2}\s*[~\-–]\s*\d{1,2}:\d{2}|^[→←↑↓]+\s*\z"
# each text that NOT_TODO or NOT_TODO_LEGACY rejects has one of these, or starts as a date or with a bracket
NOT_TODO_SIGNS = ["안녕하", "드립니다", "안내", "교장", "담당", "서울특별시", "공익제보센터", "자살예방상담", "청소년상담"]
NOT_TODO_STARTS = U + r"\A(?:\(|\d{4}\.)"
TODO_LABELS = {"노이즈": 0, "할 일": 1, "LABEL_0": 0, "LABEL_1": 1}

# rule categories and importance
MONEY = AMOUNT_WON
DATE_ANY = U + r"(?:(\d{1,2})\s*월\s*(\d{1,2})\s*일)|(?=\d)(?<![\d.])(\d{1,2})[./](\d{1,2})(?!\d)"
MONTH_ONLY = U + r"(?=\d)(?<!\d)([1-9]|1[012])월(?!\s*\d+\s*일)"
RULE_WORDS = [
    ("제출", ["제출", "내주", "보내주"]),
    ("준비물", ["준비", "가져", "챙겨", "구입", "지참"]),
    ("건강·안전", ["안전", "건강", "마스크", "위험", "유괴", "실종", "신고", "치료", "감염", "질병"]),
]
SCHEDULE_WORDS = ["일시", "기간", "까지", "예정", "실시", "평가"]
BASE_IMPORTANCE = {"제출": 1.0, "준비물": 0.85, "건강·안전": 0.80, "비용": 0.75, "일정": 0.70, "기타": 0.50}
URGENT_WORDS = ["반드시", "꼭", "필수", "엄수", "마감", "당일", "즉시", "응급", "위급", "112"]
GREETING = U + r"안녕하십니까|안녕하세요|감사드립니다|교장\z|^\d{4}\."
CATEGORIES = ["일정", "준비물", "제출", "비용", "건강·안전", "기타"]

# headers
HEADERS = [
    "운영시간", "운영방법", "운영날짜", "운영기간", "운영장소", "신청방법", "신청기간", "신청경로", "신청대상", "신청자격",
    "접수기간", "접수방법", "접수처", "제출방법", "제출기한", "제출처", "일시", "기간", "장소", "위치", "주소", "대상", "자격", "참가대상",
    "준비물", "지참물", "준비사항", "비용", "회비", "참가비", "수강료", "급식비", "기타 안내사항", "기타안내사항", "안내사항",
    "유의사항", "참고사항", "주의사항", "문의", "연락처", "문의처", "기타",
]
SLOT_HEADERS = [("dates", "일시"), ("times", "시간"), ("urls", "신청 URL"), ("phones", "연락처"), ("amounts", "비용")]
SLOT_COVERED_BY = {
    "times": ["운영시간", "신청시간", "시간"],
    "dates": ["운영날짜", "일시", "기간", "운영기간"],
    "urls": ["신청 URL", "신청경로", "신청방법"],
    "phones": ["연락처", "문의", "문의처"],
    "amounts": ["비용", "회비", "참가비", "수강료", "급식비"],
}
OTHER = "기타"

# easy Korean
EASY_WORDS = [("제출", "제출(내기)"), ("납부", "납부(지불)"), ("준비물", "준비할 것"), ("방역지침", "마스크 착용 등 방역 규칙"), ("신청", "신청"), ("개인", "각자"), ("해당", "관련")]
EASY_KEPT = U + r"\d{4}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일|\d{1,2}\s*월\s*\d{1,2}\s*일|\d{1,2}\s*/\s*\d{1,2}|\d{1,3}(?:,\d{3})+원|\d+원"
EASY_LETTER = "[가-힣A-Za-z0-9_]"
POLITE_END = r"(합니다|세요|입니다)[.!?]?\z"
ENDINGS = [("신청", "신청해야 합니다"), ("제출(내기)", "제출해야 합니다"), ("준비", "준비해야 합니다"), ("참가", "참가해야 합니다")]

# languages
LANGUAGES = ["vi", "en", "zh", "ja", "th", "ms", "mn", "ru", "ko_easy"]
NLLB_CODES = {"vi": "vie_Latn", "en": "eng_Latn", "ru": "rus_Cyrl", "ms": "zsm_Latn", "mn": "khk_Cyrl", "zh": "zho_Hans", "th": "tha_Thai", "ja": "jpn_Jpan"}
VOICES = {
    "vi": "vi-VN-HoaiMyNeural", "en": "en-US-JennyNeural", "ru": "ru-RU-SvetlanaNeural", "ms": "ms-MY-YasminNeural", "mn": "mn-MN-YesuiNeural",
    "zh": "zh-CN-XiaoxiaoNeural", "th": "th-TH-PremwadeeNeural", "ja": "ja-JP-NanamiNeural", "ko_easy": "ko-KR-SunHiNeural",
}
RESPONSE_COLUMNS = {
    "en": ["en_text", "english", "translation_en"],
    "ru": ["ru_text", "russian", "translation_ru"],
    "ms": ["ms_text", "malay", "translation_ms"],
    "mn": ["mn_text", "mongolian", "translation_mn"],
    "vi": ["corrected_vi_text", "corrected_translation", "vi_corrected_translation", "final_vi_text", "vi_text", "vietnamese", "translation_vi"],
    "zh": ["zh_text", "chinese", "translation_zh"],
    "th": ["th_text", "thai", "translation_th"],
    "ja": ["ja_text", "japanese", "translation_ja"],
}
WEEKDAYS = {
    "vi": {"월": "Thứ Hai", "화": "Thứ Ba", "수": "Thứ Tư", "목": "Thứ Năm", "금": "Thứ Sáu", "토": "Thứ Bảy", "일": "Chủ Nhật"},
    "en": {"월": "Mon", "화": "Tue", "수": "Wed", "목": "Thu", "금": "Fri", "토": "Sat", "일": "Sun"},
}
RELATIVE = {
    "vi": {"내일": "Ngày mai", "모레": "Ngày kia", "오늘": "Hôm nay", "다음 주": "Tuần sau", "다음주": "Tuần sau", "이번 주": "Tuần này", "이번주": "Tuần này"},
    "en": {"내일": "Tomorrow", "모레": "Day after tomorrow", "오늘": "Today", "다음 주": "Next week", "다음주": "Next week", "이번 주": "This week", "이번주": "This week"},
}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
WON_SUFFIX = {"vi": " won", "en": " won", "ms": " won", "ru": " вон", "mn": " вон", "th": " วอน", "zh": "韩元", "ja": "ウォン", "ko_easy": "원"}
DOLLARS = [U + r"(?i)\bđô\s*la\b", U + r"(?i)\bdollars?\b", r"\bUSD\b"]

# files
ALLOWED_SUFFIXES = ["pdf", "hwp", "hwpx", "txt", "md"]
MEAL_PLAN = U + r"에너지/단백질|①난류\s*②우유|무상급식비\s*:|\d+회\s*무상급식"

# offline pipeline
GUESS_WORDS = [
    ("일정", ["일", "월", "날짜", "기간", "기한", "마감", "행사", "수업", "체험학습", "상담", "시험", "총회", "수련회", "종업식", "신체검사"]),
    ("준비물", ["준비", "지참", "가져", "색종이", "풀", "가위", "실내화", "체육복", "물병", "돗자리", "네임펜", "크레파스"]),
    ("제출", ["제출", "내 주세요", "회신", "동의", "신청", "확인서", "참가 여부", "불참", "서류", "서명"]),
    ("비용", ["비용", "비", "원", "납부", "입금", "교육비", "체험학습비", "급식비", "수업비"]),
    ("건강·안전", ["건강", "안전", "예방", "독감", "알레르기", "감염병", "마스크", "손 소독제", "응급", "생활지도"]),
]
PHRASES = [
    ("실시됩니다", "있습니다"), ("참여합니다", "참여합니다"), ("참여해 주시기 바랍니다", "참여해 주세요"), ("준비해 주시기 바랍니다", "준비해 주세요"),
    ("제출해 주시기 바랍니다", "내 주세요"), ("납부해 주시기 바랍니다", "내 주세요"), ("등원해 주세요", "등원해 주세요"),
]
SENTENCE_END = U + r"\s(?<=[.!?。！？]\s)\s*+"
NOTE_UNCHECKED = "입력문에서 사전 용어가 감지되지 않아 자동 판단 불가"
NOTE_OK = "권장 번역어 반영"
NOTE_MISSING = "권장 번역어 미반영, 사람 검수 필요"
