"""Prices, dates, states, ids, scores and flags as column expressions. Clocks are arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelore.functions.text import blank, compact

#: States of a listing, what the service's words mean, and what the codes of two sources mean.
ON_SALE, RESERVED, SOLD = "판매중", "예약중", "판매완료"
SERVICE_STATES = {ON_SALE: ("ON_SALE", "SALE", "판매중", "판매 중"), RESERVED: ("RESERVED", "예약중", "예약 중"), SOLD: ("SOLD_OUT", "SOLD", "판매완료", "판매 완료", "거래완료")}
API_CODES = {"0": "판매중", "1": "예약중", "2": "거래중", "3": "판매완료"}
PAGE_CODES = {"0": "판매중", "1": "예약중", "3": "거래완료"}
CODE_PREFIX = "상태코드:"
#: Words of the quality flags and bounds of a plausible price.
ACCESSORY_TOKENS = ("케이스", "case", "필름", "강화유리", "맥세이프", "magsafe", "충전기", "어댑터", "커버", "스트랩", "빈박스", "상자", "트레이")
NOISE_TOKENS = ("삽니다", "매입", "광고", "문의", "대여", "렌탈", "임대", "빌리", "보증금", "구매합니다", "구합니다", "구해요", "구함", "사요", "사기꾼", "조심")
LOWEST_PRICE, HIGHEST_PRICE, EXCHANGE, EXCHANGE_LOW, EXCHANGE_HIGH = 1000, 20_000_000, "교환", 100_000, 10_000_000
#: Fixed value: the share of the median below which a price is no offer.
FLOOR_RATIO = 0.2
#: Steps of the price score by the ratio to the group's least price, and the weights of the rating.
PRICE_STEPS = ((1.0, 100.0), (1.03, 90.0), (1.08, 75.0), (1.15, 55.0), (1.30, 35.0))
WEIGHTS = {"cluster": 0.40, "price": 0.30, "view": 0.20, "recency": 0.10}
CANONICAL = r"(?i)^(갤럭시|아이폰|iphone)\s+(?:s\d{1,2}|a\d{1,2}|z플립\d{1,2}|z폴드\d{1,2}|노트\d{1,2}|\d{1,2})(?:\s+(?:프로|플러스|맥스|미니|fe))?(?:\s+\d{1,4}(?:gb|tb))?$"
SIGNAL = r"(?i)s\d{1,2}|a\d{1,2}|z플립|z폴드|노트|\d{1,2}\s*프로"
#: Factors of the estimated price series, oldest first.
ESTIMATE = (1.08, 1.05, 1.03, 1.01, 0.99, 1.02, 1.00)
LOWEST_LABEL, CURRENT_LABEL = "최저가", "현재가"


def price(value: Column, mode: str = "strict") -> Column:
    """``strict``: digits once commas are gone, else null; ``digits``: all digits; ``number``: any number."""
    text = F.trim(value.cast("string"))
    if mode == "strict":
        plain = F.regexp_replace(text, ",", "")
        return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("long"))
    if mode == "digits":
        return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("long")
    return text.try_cast("double")


def moment(value: Column, as_of: Column) -> Column:
    """The first of three formats that fits; ``as_of`` for anything else."""
    formats = ("yyyy-MM-dd HH:mm", "yyyy.MM.dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(F.trim(value), F.lit(f)) for f in formats), as_of)


def day_label(value: Column) -> Column:
    return F.date_format(value, "MM.dd")


def iso_day(value: Column) -> Column:
    return F.substring(value.cast("string"), 1, 10)


def index_date(value: Column) -> Column:
    """The date of a search document: 1970-01-01 if there is none; a date and time with seconds loses them unless it is written with a T."""
    text = blank(value.cast("string"))
    long_form = text.rlike(r"^\d{4}[-.]\d{2}[-.]\d{2} \d{2}:\d{2}:\d{2}") & ~text.contains("T")
    return F.when(text == "", "1970-01-01").when(long_form, F.substring(text, 1, 16)).otherwise(text)


def import_state(value: Column) -> Column:
    """The state of an imported or indexed row: one of the three as it stands, else on sale."""
    text = blank(value)
    return F.when(text.isin(ON_SALE, RESERVED, SOLD), text).otherwise(ON_SALE)


def csv_state(value: Column) -> Column:
    """The state of a row of the CSV reader: what is neither on sale nor reserved is sold."""
    text = blank(value)
    return F.when(text.isin(ON_SALE, RESERVED), text).otherwise(SOLD)


def state(value: Column, default: str = ON_SALE) -> Column:
    """The state that a word of the service means."""
    out = F.lit(default)
    for name, words in SERVICE_STATES.items():
        out = F.when(value.isin(*words), name).otherwise(out)
    return F.when(blank(value) == "", default).otherwise(out)


def code_state(value: Column, codes: dict[str, str]) -> Column:
    """The state of a source's code; an unknown code stays in sight."""
    text = value.cast("string")
    out = F.concat(F.lit(CODE_PREFIX), text)
    for code, name in codes.items():
        out = F.when(text == code, name).otherwise(out)
    return out


def image_url(value: Column, size: int = 720) -> Column:
    """The image's address with its size put in; null for none."""
    return F.replace(F.nullif(blank(value), F.lit("")), F.lit("{res}"), F.lit(str(size)))


def images(value: Column, times: int = 1) -> Column:
    """The list of images: the address once for the search service, three times for the product service."""
    return F.when(blank(value) != "", F.array(*[value] * times)).otherwise(F.array().cast("array<string>"))


def stable_id(platform: Column, pid: Column) -> Column:
    return F.crc32(F.concat_ws(":", platform, pid).cast("binary"))


def stable_share(seed: Column) -> Column:
    """A number from 0 to 1 that a seed always gets."""
    return F.crc32(seed.cast("binary")) / F.lit(float(0xFFFFFFFF))


def cluster_score(name: Column, route: Column) -> tuple[Column, Column]:
    """Score and confidence by the route, or by the name where there is none."""
    known, name = F.lower(blank(route)), blank(name)
    score = (
        F.when(known == "canonical", 100.0).when(known == "accessory", 90.0).when(known == "token", 45.0)
        .when(name.rlike(CANONICAL), 95.0).when(name.rlike("(케이스|필름)$"), 85.0).when(name.rlike(SIGNAL), 65.0).when(name != "", 45.0).otherwise(20.0)
    )
    return score, score / 100


def price_score(value: Column, least: Column) -> Column:
    ratio = value / least
    out = F.greatest(F.lit(0.0), 100 - (ratio - 1) * 100)
    for most, score in reversed(PRICE_STEPS):
        out = F.when(ratio <= most, score).otherwise(out)
    return F.when(value.isNull() | (value <= 0), 0.0).when(least.isNull() | (least <= 0), 50.0).otherwise(out)


def view_score(views: Column, most: Column) -> Column:
    return F.when((F.coalesce(most, F.lit(0)) <= 0) | (F.coalesce(views, F.lit(0)) <= 0), 0.0).otherwise(F.least(F.lit(100.0), views / most * 100))


def recency_score(seen: Column, as_of: Column, full: float = 1.0, zero: float = 30.0) -> Column:
    days = (as_of.cast("double") - seen.cast("double")) / 86400
    return F.when(seen.isNull(), 0.0).when(days <= full, 100.0).when(days >= zero, 0.0).otherwise((zero - days) / (zero - full) * 100)


def rating(cluster: Column, price_: Column, view: Column, recency: Column) -> Column:
    total = cluster * WEIGHTS["cluster"] + price_ * WEIGHTS["price"] + view * WEIGHTS["view"] + recency * WEIGHTS["recency"]
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2)


def flag_words(title: Column) -> Column:
    """What ``quality_flags`` need of a title: whether it holds words of accessories, of noise, and of an exchange."""
    text = compact(title)
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.call_function("contains", text, w))
    return F.struct(holds(ACCESSORY_TOKENS).alias("accessory"), holds(NOISE_TOKENS).alias("noise"), text.contains(EXCHANGE).alias("swap"))


def quality_flags(title: Column, value: Column) -> Column:
    return flags_of(flag_words(title), value)


def flags_of(words: Column, value: Column) -> Column:
    """``quality_flags`` of a title's ``flag_words`` and its price."""
    bad = (value < LOWEST_PRICE) | (value >= HIGHEST_PRICE) | (words["swap"] & ((value < EXCHANGE_LOW) | (value >= EXCHANGE_HIGH)))
    flags = F.array(F.when(words["accessory"], F.lit("accessory_candidate")), F.when(words["noise"], F.lit("noise_candidate")), F.when(bad, F.lit("invalid_price")))
    return F.filter(flags, lambda f: f.isNotNull())


#: Names of category ids; ordered rules (category, words) and (brand, words), of which the first that fits wins; what stands for none.
CATEGORY_IDS = {"pc": "컴퓨터", "laptop": "노트북", "phone": "핸드폰", "bike": "자전거", "cloth": "의류", "shoes": "신발", "goods": "굿즈", "camera": "카메라", "game": "게임기", "furniture": "가구", "music": "악기", "camping": "캠핑"}
CATEGORY_RULES = (
    ("노트북", ("노트북", "랩탑", "그램", "갤럭시북", "thinkpad", "씽크패드", "맥북")),
    ("컴퓨터", ("컴퓨터", "데스크탑", "본체", "게이밍 pc", "게이밍pc", "pc본체")),
    ("핸드폰", ("아이폰", "갤럭시", "스마트폰", "휴대폰", "핸드폰")),
    ("자전거", ("자전거",)),
    ("카메라", ("카메라", "디카")),
    ("게임기", ("닌텐도", "스위치", "플스", "플레이스테이션", "ps5", "ps4", "xbox", "엑스박스", "스팀덱")),
    ("태블릿", ("아이패드", "갤럭시탭", "태블릿")),
    ("이어폰", ("에어팟", "버즈", "이어폰", "헤드셋", "헤드폰")),
    ("스마트워치", ("애플워치", "갤럭시워치", "스마트워치")),
    ("의류", ("의류", "원피스", "자켓", "셔츠", "바지")),
    ("신발", ("신발", "운동화", "스니커즈")),
    ("가구", ("가구", "테이블", "의자", "책상")),
    ("악기", ("기타", "피아노", "악기")),
    ("캠핑", ("캠핑", "텐트")),
)
BRAND_RULES = (
    ("삼성", ("삼성", "갤럭시")),
    ("LG", ("엘지", "lg", "그램")),
    ("Apple", ("애플", "아이폰", "맥북", "아이패드", "애플워치", "에어팟")),
    ("Lenovo", ("레노버", "lenovo", "thinkpad", "씽크패드")),
    ("ASUS", ("asus", "에이수스")),
    ("MSI", ("msi",)),
    ("Nintendo", ("닌텐도", "nintendo")),
    ("Sony", ("소니", "플스", "플레이스테이션", "ps5", "ps4")),
    ("Microsoft", ("마이크로소프트", "xbox", "엑스박스")),
)
OTHER_CATEGORY, OTHER_BRAND = "기타", "중고상품"
#: Parts of an address and the platforms they tell, in order.
PLATFORM_URLS = (("joongna", "중고나라"), ("bunjang", "번개장터"), ("daangn", "당근마켓"))
OTHER_PLATFORM = "중고거래"


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.call_function("contains", text, w))


def by_words(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    """The name of the first rule with a word that the lower-cased text holds."""
    lower, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(default)
    for name, words in reversed(rules):
        out = F.when(holds_any(lower, words), name).otherwise(out)
    return out


def category_of_id(value: Column) -> Column:
    """The name of a category id; other values stay as they are."""
    out = blank(value)
    for known, name in CATEGORY_IDS.items():
        out = F.when(blank(value) == known, name).otherwise(out)
    return out


def category(name: Column, *texts: Column) -> Column:
    """The given category, else the one that the texts tell."""
    told = by_words(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)), CATEGORY_RULES, OTHER_CATEGORY)
    return F.when(blank(name) != "", blank(name)).otherwise(told)


def brand(category_: Column, *texts: Column) -> Column:
    """The brand that the texts tell, else the category, else a word for used goods."""
    told = F.nullif(by_words(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)), BRAND_RULES, ""), F.lit(""))
    return F.coalesce(told, F.when((blank(category_) != "") & (category_ != OTHER_CATEGORY), category_), F.lit(OTHER_BRAND))


def platform(name: Column, url: Column) -> Column:
    found, lower = F.lit(OTHER_PLATFORM), F.lower(F.coalesce(url, F.lit("")))
    for part, told in reversed(PLATFORM_URLS):
        found = F.when(lower.contains(part), told).otherwise(found)
    return F.when(blank(name) != "", blank(name)).otherwise(found)


def estimated_series(current: Column, as_of: Column) -> Column:
    """Seven daily points that end at the current price, rounded to thousands, 1000 at least."""
    points = [F.struct(F.date_sub(as_of, len(ESTIMATE) - 1 - k).alias("day"), F.greatest(F.lit(1000), F.floor(current * f / 1000 + 0.5) * 1000).cast("long").alias("price")) for k, f in enumerate(ESTIMATE)]
    return F.array(*points)


def service_series(current: Column, lowest: Column, as_of: Column) -> Column:
    """(label, price) points: none without a price, the lowest and the current price, or an estimate where no lowest is known."""
    pair = F.array(F.struct(F.lit(LOWEST_LABEL).alias("label"), lowest.cast("long").alias("price")), F.struct(F.lit(CURRENT_LABEL).alias("label"), current.cast("long").alias("price")))
    made = F.transform(estimated_series(current, as_of), lambda p: F.struct(day_label(p["day"]).alias("label"), p["price"].alias("price")))
    none = F.array().cast("array<struct<label: string, price: bigint>>")
    return F.when(F.coalesce(current, F.lit(0)) <= 0, none).when(F.coalesce(lowest, F.lit(0)) <= 0, made).otherwise(pair)


def description(given: Column, title: Column, platform_: Column) -> Column:
    """The given description, else a sentence on the title and the platform; nothing without a title."""
    own = F.coalesce(title, F.lit(""))
    tail = F.lit("상세 상태와 거래 조건은 원본 페이지에서 확인해 주세요.")
    where = F.concat(own, F.lit(" 상품입니다. "), platform_, F.lit("에서 수집한 실제 중고거래 매물이며, "), tail)
    return F.when(blank(own) == "", "").when(blank(given) != "", blank(given)).when(blank(platform_) == "", F.concat(own, F.lit(" 상품입니다. "), tail)).otherwise(where)


#: Words that suggest what a token may be used for, in order.
NOISE_WORDS = ("a급", "급처", "무료", "공짜", "구매", "구함", "구해요", "나눔", "대여", "렌탈", "매입", "문의", "삽니다", "업자", "전단", "판매", "판매합니다", "홍보")
LOW_SIGNAL_WORDS = ("강화유리", "맥세이프", "액정", "케이스", "클리어", "필름")
DETAIL_WORDS = ("프로", "맥스", "울트라", "플러스", "엣지", "에어", "pro", "max", "ultra", "plus", "edge", "air")
BRAND_WORDS = ("아이폰", "iphone", "갤럭시", "galaxy", "애플", "apple", "삼성", "samsung", "lg", "엘지")
USES = {"exclude": "token_exclude_list 후보", "spec": "product_token_dictionary spec 후보", "detail": "product_token_dictionary detail 후보", "brand": "product_token_dictionary brand 후보", "model": "product_token_dictionary model 후보", "open": "검토 필요"}


def token_use(token: Column) -> Column:
    """What a token of the reference lists may be used for."""
    own = compact(token)
    return (
        F.when(token.isin(*NOISE_WORDS, *LOW_SIGNAL_WORDS), USES["exclude"])
        .when(own.rlike(r"^(?:[0-9]{2,4}(?:g|gb|기가)|1tb|1테라)$"), USES["spec"])
        .when(own.isin(*DETAIL_WORDS), USES["detail"]).when(own.isin(*BRAND_WORDS), USES["brand"])
        .when(own.rlike("^(?:s[0-9]{2}(?:plus|ultra|edge)?|[0-9]{2}e?)$"), USES["model"]).otherwise(USES["open"])
    )


#: Names of clusters that hold a brand only, and the name for what has no better one.
GENERIC_ROOTS, MISC, NO_KEYWORD = ("갤럭시", "아이폰", "아이패드", "맥북", "galaxy", "iphone", "ipad", "macbook"), "기타 상품", "키워드 시세"


def product_keyword(category_: Column, name_tokens: Column) -> Column:
    """The heading under which a picker shows a product: its category unless that is a bare brand, else the first two tokens of its name."""
    own = blank(category_)
    first = F.array_join(F.slice(name_tokens, 1, 2), " ")
    return F.when((own != "") & ~compact(own).isin(*GENERIC_ROOTS), own).when((own == "") & (first != ""), first).otherwise(MISC)


def comparison_keyword(category_: Column, name_tokens: Column) -> Column:
    """What a product is compared by: its category, else the first two tokens of its name."""
    first = F.array_join(F.slice(name_tokens, 1, 2), " ")
    return F.when(blank(category_) != "", blank(category_)).when(first != "", first).otherwise(NO_KEYWORD)


def outlier_detail(value: Column, low: Column, high: Column, median: Column, group: Column, kind: Column, label: str = "keyword") -> Column:
    """The sentence of the drop log on an outlier; ``kind`` is low or high."""
    money = lambda c: F.format_number(F.coalesce(c, F.lit(0)).cast("double"), 0)
    head = F.concat(F.lit(f"{label}="), blank(group), F.lit(", price="), money(value))
    bound = F.when(kind == "low", F.concat(F.lit("lower_bound="), money(low))).otherwise(F.concat(F.lit("upper_bound="), money(high)))
    return F.concat_ws(", ", head, bound, F.concat(F.lit("median="), money(median)))
