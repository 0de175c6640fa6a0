"""Tags of chat messages by ordered rules: intent, keyword, product type, price range, game, level, template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelore.functions import text as T
from pricelore.functions import values as V

#: Ordered rules (intent, words of which one does, groups of which every word is needed).
INTENTS = (
    ("GREETING", ("hello", "hi", "안녕"), ()),
    ("ITEM_COUNT", ("몇개", "count", "itemcount"), ()),
    ("WISHLIST_LIST", (), ("찜", "목록")),
    ("PERSONAL_RECOMMEND", ("personal", "custom", "맞춤"), ()),
    ("PRICE_COMPARE", ("compare", "price", "비교", "비싼", "살까"), ()),
    ("PRICE_ALERT_GUIDE", ("alert", "알림"), ()),
    ("SEARCH_HELP", ("search", "검색"), ()),
    ("PRODUCT_RECOMMEND", ("recommend", "find", "추천", "찾아"), ()),
)
RECOMMEND, UNKNOWN = "PRODUCT_RECOMMEND", "UNKNOWN"
#: Words of a message that asks for a computer to play on, and what follows from it.
GAMING_WORDS, COMPUTER_WORDS = ("game", "gaming", "lol", "pubg", "cyberpunk", "게임", "롤", "배그", "사이버펑크"), ("computer", "desktop", "pc", "컴퓨터", "본체")
COMPUTER, DESKTOP, GAMING, USUAL_LEVEL = "컴퓨터", "desktop", "gaming", "MID"
#: Patterns of phones, ordered rules (keyword, words) for other products, words that are no part of a keyword.
PHONES = (("아이폰", r"(?i)(iphone|아이폰)\s*(\d{1,2})?\s*(pro|max|mini|plus|프로|미니|플러스)?", 2), ("갤럭시", r"(?i)(galaxy|갤럭시)\s*(s\d{1,2}|fold\d*|flip\d*|note\d*)?", 1))
KEYWORDS = (("맥북", ("맥북",)), ("노트북", ("노트북",)), ("컴퓨터", ("컴퓨터", "pc")), ("닌텐도 스위치", ("닌텐도", "스위치")), ("PS5", ("ps5",)), ("PS4", ("ps4",)))
FILLER = r"(?i)recommend|find|compare|price|please"
#: Ordered rules (product type, words).
PRODUCT_TYPES = (
    ("desktop", ("computer", "desktop", "pc", "컴퓨터", "데스크탑")),
    ("laptop", ("laptop", "macbook", "노트북", "맥북")),
    ("smartphone", ("iphone", "galaxy", "아이폰", "갤럭시")),
    ("game_console", ("switch", "ps5", "ps4", "xbox", "닌텐도")),
)
AT_MOST, AT_LEAST = ("이하", "까지"), ("이상", "부터")
#: Ordered rules (game, words), and (level, words) of a message; levels from the least.
GAMES = (
    ("롤", ("롤", "리그오브레전드", "leagueoflegends", "lol")),
    ("발로란트", ("발로란트", "valorant")),
    ("배그", ("배그", "배틀그라운드", "pubg")),
    ("에이펙스 레전드", ("에이펙스", "apex")),
    ("오버워치2", ("오버워치", "overwatch")),
    ("로스트아크", ("로스트아크", "로아", "lostark")),
    ("엘든링", ("엘든링", "eldenring")),
    ("사이버펑크", ("사이버펑크", "cyberpunk")),
    ("GTA5", ("gta", "gta5")),
    ("디아블로4", ("디아블로", "diablo")),
    ("레드 데드 리뎀션2", ("레드데드", "reddead")),
    ("검은 신화: 오공", ("검은신화", "오공", "blackmyth", "wukong")),
    ("러스트", ("러스트", "rust")),
    ("메이플스토리", ("메이플", "maplestory")),
    ("FC온라인", ("피파", "fc온라인", "fconline", "fifa")),
    ("스타크래프트", ("스타크래프트", "starcraft")),
)
LEVEL_WORDS = (
    ("EXTREME", ("4k", "레이tracing", "레이트레이싱", "울트라", "최상옵", "최고옵")),
    ("HIGH", ("qhd", "144hz", "고사양", "상옵", "높은옵션", "사이버펑크", "엘든링", "gta", "디아블로", "검은신화", "오공", "aaa")),
    ("MID", ("배그", "배틀그라운드", "pubg", "에이펙스", "apex", "오버워치", "로스트아크", "러스트", "rust")),
    ("LOW", ("롤", "리그오브레전드", "lol", "발로란트", "메이플", "피파", "fc온라인", "스타크래프트")),
    ("MID", ("게임", "게이밍", "플레이", "돌아가는")),
)
LEVELS = ("LOW", "MID", "HIGH", "EXTREME")
#: Ordered rules (graphics cards, memory in GB, level with it, level with less).
CARDS = (
    (("rtx4090", "rtx4080", "rx7900"), 0, "EXTREME", "EXTREME"),
    (("rtx4070", "rtx3090", "rtx3080", "rtx4060", "rtx3070", "rtx3060", "rx7800", "rx6800", "rx6700", "rx6600"), 16, "HIGH", "MID"),
    (("rtx2060", "gtx1660", "gtx1650", "gtx1080", "gtx1070", "gtx1060", "rx590", "rx580", "rx570"), 8, "MID", "LOW"),
    (("gtx1050", "gtx950", "gt730", "rx560", "rx550", "uhd", "iris", "vega"), 0, "LOW", "LOW"),
)
#: Ordered rules (template, words of the subject, words of the question), and words in and out of scope.
TEMPLATES = (
    ("SERVICE_INTRO", ("하마", "서비스", "사이트", "뭐하는", "설명"), ("뭐", "소개", "기능", "사용", "알려")),
    ("SEARCH_HELP", ("검색", "찾는법", "찾기", "상품찾"), ("방법", "어떻게", "사용", "하는법")),
    ("PRICE_COMPARE_GUIDE", ("가격비교", "비교", "최저가", "평균가", "살래말래"), ("방법", "기준", "어떻게", "판단", "설명")),
    ("WISHLIST_GUIDE", ("찜", "하트", "관심"), ("방법", "어떻게", "목록", "저장", "확인")),
    ("RECENT_ITEM_GUIDE", ("최근본", "최근열람", "본상품"), ("방법", "어떻게", "확인", "목록", "비교")),
    ("PRICE_ALERT_GUIDE", ("알림", "가격알림", "종"), ("방법", "어떻게", "설정", "등록", "확인")),
    ("CHATBOT_HELP", ("챗봇", "ai", "상담"), ("기능", "뭐", "도움", "질문", "사용")),
    ("AUTH_GUIDE", ("로그인", "회원가입", "계정", "마이페이지"), ("방법", "필요", "어떻게", "사용", "안돼")),
)
IN_SCOPE = ("상품", "가격", "중고", "검색", "추천", "찜", "알림", "하마", "챗봇", "마이페이지", "아이폰", "갤럭시", "노트북", "컴퓨터", "자전거", "의류", "신발", "가구", "카메라", "게임")
OUT_OF_SCOPE, OTHER_SUBJECTS = "OUT_OF_SCOPE", ("날씨", "음식", "맛집", "여행", "연예", "주식", "코인", "정치", "뉴스", "숙제", "번역", "소설", "영화", "운세")
ADVICE_WORDS = ("왜비싸", "비싼", "싼거", "가격괜찮", "살래말래", "살까", "말까", "판단", "적정가", "가격어때")
LAUNCH_WORDS = ("출시가", "정가", "새상품가격", "중고말고", "원래가격")


def first_rule(text: Column, rules: tuple) -> Column:
    """The name of the first rule with a word that the text holds; null if there is none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(rules):
        out = F.when(V.holds_any(text, words), name).otherwise(out)
    return out


def question(text: Column) -> Column:
    """A message without white space and end marks, in lower case."""
    return F.regexp_replace(T.solid(text), r"[?.,!~]", "")


def game_text(text: Column) -> Column:
    return F.regexp_replace(T.solid(text), "[_/-]", "")


def keyword(message: Column) -> Column:
    """The product that a message names: a phone with its model, another known product, else the message without filler."""
    raw, solid = T.blank(message), T.solid(message)
    out = T.tidy(F.regexp_replace(raw, FILLER, ""))
    for name, words in reversed(KEYWORDS):
        out = F.when(V.holds_any(solid, words), name).otherwise(out)
    for name, pattern, groups in reversed(PHONES):
        parts = [F.trim(F.regexp_extract(raw, pattern, k + 2)) for k in range(groups)]
        out = F.when(raw.rlike(pattern), F.array_join(F.filter(F.array(F.lit(name), *parts), lambda x: x != ""), " ")).otherwise(out)
    return out


def price_range(message: Column) -> Column:
    """(min_price, max_price) of the first two amounts in units of ten thousand: two make a range, one is a bound if the message says which."""
    solid = T.solid(message)
    found = F.transform(F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(r"(\d+)\s*만"), F.lit(1)), lambda x: x.try_cast("long") * 10000)
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    made = lambda low, high: F.struct(low.cast("long").alias("min_price"), high.cast("long").alias("max_price"))
    none = F.lit(None)
    return F.when(F.size(found) >= 2, made(F.least(first, second), F.greatest(first, second))).when((F.size(found) == 1) & V.holds_any(solid, AT_MOST), made(none, first)).when((F.size(found) == 1) & V.holds_any(solid, AT_LEAST), made(first, none)).otherwise(made(none, none))


def template(message: Column) -> Column:
    """The guide that answers a message, out of scope for other subjects, null for neither."""
    text = question(message)
    out = F.when(~V.holds_any(text, IN_SCOPE) & V.holds_any(text, OTHER_SUBJECTS), OUT_OF_SCOPE)
    for name, subject, asks in reversed(TEMPLATES):
        out = F.when(V.holds_any(text, subject) & V.holds_any(text, asks), name).otherwise(out)
    return F.when(text != "", out)


def level_of_specs(card: Column, memory: Column) -> Column:
    """LOW to EXTREME from graphics card and memory, UNKNOWN for other cards."""
    own, out = game_text(card), F.lit(UNKNOWN)
    for words, least, level, less in reversed(CARDS):
        out = F.when(V.holds_any(own, words), F.when(F.coalesce(memory, F.lit(0)) >= least, level).otherwise(less)).otherwise(out)
    return out


def level_at_least(level: Column, asked: Column) -> Column:
    """Whether both levels are known and the first is no less."""
    order = F.array(*map(F.lit, LEVELS))
    own, want = (F.coalesce(F.array_position(order, F.upper(c)), F.lit(0)) for c in (level, asked))
    return (own > 0) & (want > 0) & (own >= want)


def message_tags(messages: DataFrame) -> DataFrame:
    """(message_id, intent, keyword, product_type, use_case, min_price, max_price, game, level, template, asks_price_advice, asks_launch_price) of each (message_id, message)."""
    message = F.col("message")
    solid, games = T.solid(message), game_text(message)
    known = F.lit(UNKNOWN)
    for name, one, every in reversed(INTENTS):
        fits = V.holds_any(solid, one) if one else F.lit(True)
        for word in every:
            fits = fits & solid.contains(word)
        known = F.when(fits, name).otherwise(known)
    gaming = V.holds_any(solid, GAMING_WORDS) & V.holds_any(solid, COMPUTER_WORDS)
    found = messages.select(
        "message_id", "message", gaming.alias("gaming"), known.alias("known"), F.when(gaming, COMPUTER).otherwise(keyword(message)).alias("keyword"),
        first_rule(games, GAMES).alias("game"), first_rule(games, LEVEL_WORDS).alias("level"), price_range(message).alias("prices"),
    )
    kind = first_rule(T.solid(F.concat_ws(" ", "keyword", F.coalesce("message", F.lit("")))), PRODUCT_TYPES)
    intent = F.when(F.col("gaming") | ((F.col("known") == UNKNOWN) & (T.blank(F.col("keyword")) != "")), RECOMMEND).otherwise(F.col("known"))
    return found.select(
        "message_id", intent.alias("intent"), "keyword", F.when(F.col("gaming"), DESKTOP).otherwise(kind).alias("product_type"), F.when(F.col("gaming"), GAMING).alias("use_case"),
        "prices.min_price", "prices.max_price", "game", F.when(F.col("gaming"), F.coalesce("level", F.lit(USUAL_LEVEL))).otherwise(F.col("level")).alias("level"), template(message).alias("template"),
        V.holds_any(F.regexp_replace(T.blank(message), r"(?U)\s+", ""), ADVICE_WORDS).alias("asks_price_advice"), V.holds_any(F.regexp_replace(T.blank(message), r"(?U)\s+", ""), LAUNCH_WORDS).alias("asks_launch_price"),
    )
