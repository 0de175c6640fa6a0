"""Title text as column expressions: normal forms, tokens, cleaned names.

All patterns use the Unicode classes of Java's engine ((?U)), so that word edges hold for Hangul. A null text counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]

#: Spelled-out forms of the model words.
SPELLED: tuple[Rule, ...] = (
    (r"(?<=[a-z0-9])plus\b", " 플러스"),
    (r"\bplus\b|[+＋]", " 플러스 "),
    (r"\bpro\b", " 프로 "),
    (r"\bmax\b", " 맥스 "),
    (r"\bultra\b", " 울트라 "),
)
#: The index form also parts scripts and compound words.
PARTED: tuple[Rule, ...] = ((r"([가-힣])([a-z0-9])", "$1 $2"), (r"([a-z0-9])([가-힣])", "$1 $2"), ("프로맥스", "프로 맥스"), ("플러스", " 플러스 "), ("울트라", " 울트라 "))

#: Words that say nothing about the product, by kind, in the order in which they are taken out.
REGIONS = "부산중고폰 인천중고폰 김해중고폰 양산중고폰 서울 부산 대구 인천 광주 대전 울산 세종 경기 강원 충북 충남 전북 전남 경북 경남 제주 수원 성남 고양 용인 부천 안산 안양 남양주 화성 평택 의정부 시흥 파주 김포 광명 하남 군포 김해 창원 진주 포항 천안 청주 전주 목포 여수 순천 양산 구미 안동 춘천 마산 일산 분당 판교 강남 홍대 신촌 건대 잠실".split()
TRADE = "판매합니다 판매해요 판매중 판매완료 판매 팝니다 팔아요 팔아봅니다 팔아여 구매합니다 구해요 구합니다 삽니다 매입 급처합니다 급처 급매 일괄판매 일괄 택포 착불 배송 직거래 거래 네고 에눌 미개봉 새상품 신품 중고 정품 풀박스 풀박 단품 교환 대여 렌탈 당일배송 당일발송 새제품 제품".split()
CONDITION = "무잔상 유잔상 잔상 무기스 기스 스크래치 께끗 깨끗 깔끔 클린 깨끗한 깨끗한기기 (?:aa|aaa|ss|s|a|b|c|d|e)급 리퍼급 새상품급 중고급 민트급 미사용급 정상공기기 정상해지 공기기 공기계 자급제 해지".split()
COLOURS = "블랙 화이트 실버 골드 그레이 그린 레드 블루 핑크 퍼플 바이올렛 라벤더 민트 네이비 옐로우 크림 베이지 코랄 오렌지 차콜 티타늄 티타니움 아이스블루 딥퍼플 스카이블루 메탈릭 코퍼 브론즈 로즈골드 스페이스그레이 그래파이트 실버쉐도우 엠버 옐로우 바이올렛 라이트그린 다크그레이 미드나잇 스타라이트 퍼플 블루쉐도우 엠버옐로우 메탈릭코퍼".split()
GENERIC = "삼성 휴대폰 스마트폰 파라요 공기기 공기계 도매 할인가능 네고 에눌".split()
#: Names of model series.
MODELS = (r"s\d{1,2}(?:fe|e|플러스|프로|울트라|엣지)?", r"a\d{1,2}", r"z플립\d{1,2}", r"z폴드\d{1,2}", r"노트\d{1,2}", r"버디\d", r"와이드\d{1,2}", r"워치\d{1,2}", r"아이폰\d{1,2}(?:프로맥스|프로|플러스|맥스|미니|fe)?", r"\d+\.\d+")
STORAGE = r"\d{1,4}(?:gb|tb)"
MODEL, BOUNDARY = "|".join(MODELS), "|".join((*MODELS, STORAGE))
#: Tokens that are left out of clusters.
EXCLUDED = "무 잔상 유 기스 무기스 급 a급 b급 s급 ss급 aa급 aaa급 리퍼급 새상품급 께끗 깨끗 깔끔 새 제품 당일배송 당일발송 새제품 삼성 폰 휴대폰 스마트폰 파라요 공기기 공기계 도매 . 티파이".split()

#: Each noise list as one alternation, in list order: the first word that fits at a place is taken out there.
NOISE: tuple[Rule, ...] = (
    (r"케이스\s*티파이", "케이스티파이"),
    *(("|".join(words), " ") for words in (REGIONS, TRADE, CONDITION, COLOURS, GENERIC)),
    (r"\b폰\b", " "),
    (r"\b새\b", " "),
    (r"\b\d{1,2}\.\d{1,2}\.\d{1,2}\)?\b", " "),
    (r"(?:^|\s)\.(?:\s|$)", " "),
)
UNITS: tuple[Rule, ...] = ((r"(\d{1,4})\s+gb\b", "$1gb"), (r"(\d{1,4})\s*기가\b", "$1gb"), (r"(\d{2,4})g\b", "$1gb"), (r"(\d{1,4})\s*tb\b", "$1tb"))
JOINED: tuple[Rule, ...] = (
    (r"\bs\s+(\d{1,2})\s+엣지\b", "s$1엣지"),
    (r"\bs\s+(\d{1,2})(?:\s*(fe|플러스|프로|울트라|엣지))?\b", "s$1$2"),
    (r"\ba\s+(\d{1,2})\b", "a$1"),
    *((rf"{word}\s+(\d{{1,2}})\b", f"{word}$1") for word in ("노트", "와이드", "워치")),
    *((rf"z\s*{word}\s*(\d{{1,2}})\b", f"z{word}$1") for word in ("플립", "폴드")),
    (r"아이폰\s*(\d{1,2})\s*(프로맥스|프로|플러스|맥스|미니|fe)\b", "아이폰$1$2"),
    (r"아이폰\s+(\d{1,2})\b", "아이폰$1"),
    (r"버디\s+(\d)\b", "버디$1"),
)
SPACES: Rule = (r"\s+", " ")


def apply(text: Column, rules: tuple[Rule, ...]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, f"(?U){r[0]}", r[1]), rules, text)


def tidy(text: Column) -> Column:
    return F.trim(apply(text, (SPACES,)))


def blank(text: Column) -> Column:
    """The trimmed text, empty for null."""
    return F.coalesce(F.trim(text), F.lit(""))


def normal(text: Column, dots: str = "decimal", punctuation: bool = False, parted: bool = False) -> Column:
    """The normal form of a title. ``dots``: ``decimal`` keeps a dot next to a digit, ``none`` keeps none. ``punctuation`` keeps all signs; ``parted`` puts spaces between scripts."""
    text = apply(F.lower(F.coalesce(text, F.lit(""))), (PARTED if parted else ()) + SPELLED)
    if not punctuation:
        keep = r"[^0-9a-z가-힣\s.]+" if dots == "decimal" else r"[^0-9a-z가-힣\s]+"
        text = apply(text, ((keep, " "), *(((r"(?<![0-9])\.(?![0-9])", " "),) if dots == "decimal" else ())))
    return tidy(text)


def compact(text: Column, normalised: bool = True) -> Column:
    return F.regexp_replace(normal(text) if normalised else F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", "")


def title_tokens(text: Column) -> Column:
    """Words of the normal form without signs at their edges."""
    words = F.transform(F.split(normal(text, "none"), " "), lambda w: F.regexp_replace(w, r"(?U)^\W+|\W+$", ""))
    return F.filter(words, lambda w: w != "")


def keyword_tokens(text: Column, trailing: bool = True) -> Column:
    """Runs of letters with digits (and a letter behind, if ``trailing``), Hangul, letters, digits."""
    first = "[a-z]+[0-9]+[a-z]?" if trailing else "[a-z]+[0-9]+"
    return F.regexp_extract_all(normal(text, "none"), F.lit(f"{first}|[가-힣]+|[a-z]+|[0-9]+"), F.lit(0))


def least_tokens(text: Column, length: int = 2) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\W_]+"), lambda w: F.length(w) >= length)


def split_list(text: Column, separators: str = r"[,/;|]") -> Column:
    """The distinct trimmed entries of a list in a cell, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separators), lambda x: F.trim(x)), lambda x: x != ""))


def jaccard(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def cluster_text(title: Column) -> Column:
    """The cleaned name from which clusters are made."""
    text = normal(apply(F.coalesce(title, F.lit("")), ((r"\([^)]*\)|\[[^\]]*\]", " "),)))
    text = apply(tidy(apply(text, NOISE)), UNITS)
    text = tidy(apply(tidy(text), JOINED))
    text = tidy(apply(text, ((r"\b\d+\b", " "),)))
    return tidy(apply(tidy(apply(text, ((f"(?:{BOUNDARY})", " $0 "),))), (UNITS[0],)))


#: Accessory words by rank, variants of a model, brand words of accessories.
ACCESSORIES, VARIANTS, ACCESSORY_BRANDS = ("케이스", "필름"), ("프로", "플러스", "맥스", "미니", "fe", "엣지", "울트라", "프로맥스"), ("티파이", "케이스티파이", "casetify")
#: Names and variants of phone models that are put together again.
IPHONE, IPHONE_VARIANT = "아이폰", r"\d{1,2}(?:프로맥스|프로|플러스|맥스|미니|fe)"
FRAGMENT = r"^(?:갤럭시)?[sa]\d$|^[sa]$"


def is_fragment(token: Column) -> Column:
    """Whether a token is a piece of a model's name that says nothing alone."""
    return token.rlike(FRAGMENT) & ~token.rlike(f"^(?:{MODEL})$")


def merge_iphone(tokens: Column) -> Column:
    """Tokens in which the brand and the variant behind it are one: ``아이폰`` ``16프로`` and ``아이폰`` ``16`` ``프로``. Tokens hold no white space, so the joined list is rewritten from the left, whole tokens only."""
    text = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    text = F.regexp_replace(text, rf" {IPHONE}  ({IPHONE_VARIANT}) ", f" {IPHONE}$1 ")
    text = F.regexp_replace(text, rf" {IPHONE}  (\d{{1,2}})  ({'|'.join(VARIANTS)}) ", f" {IPHONE}$1$2 ")
    return F.filter(F.split(text, " "), lambda t: t != "")


def kept_tokens(text: Column) -> Column:
    """The tokens of a cleaned name that count for clusters."""
    return F.filter(F.split(text, " "), lambda t: (t != "") & ~t.isin(*EXCLUDED) & ~t.rlike("^[0-9]+$"))


def model_token(tokens: Column) -> Column:
    """The longest model name among the tokens, the first of equals; null if there is none."""
    found = F.filter(tokens, lambda t: t.rlike(f"^(?:{MODEL})$"))
    ranked = F.transform(found, lambda t, k: F.struct(F.length(t).alias("size"), (-k).alias("early"), t.alias("token")))
    return F.array_max(ranked)["token"]


def storage_token(tokens: Column) -> Column:
    return F.get(F.filter(tokens, lambda t: t.rlike(f"^{STORAGE}$")), F.lit(0))



def accessory_words(tokens: Column, text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, ACCESSORIES)), lambda a: text.contains(a) | F.array_contains(tokens, a))


def route(tokens: Column, text: Column) -> Column:
    return F.when(F.size(accessory_words(tokens, text)) > 0, "accessory").when(model_token(tokens).isNotNull(), "canonical").otherwise("token")


def model_label(keyword: Column, model: Column) -> Column:
    """``keyword number suffix`` for a model that begins with the keyword, else ``keyword model``."""
    rest = F.when((keyword != "") & model.startswith(keyword), F.substring(model, F.length(keyword) + 1, F.length(model)))
    number = F.regexp_extract(rest, r"^(\d{1,2})(프로맥스|프로|플러스|맥스|미니|fe|엣지|울트라)?$", 1)
    suffix = F.regexp_replace(F.regexp_extract(rest, r"^(\d{1,2})(프로맥스|프로|플러스|맥스|미니|fe|엣지|울트라)?$", 2), "^프로맥스$", "프로 맥스")
    parts = F.when(rest.isNull(), F.array(keyword, model)).when(number != "", F.array(keyword, number, suffix)).otherwise(F.array(keyword, rest))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def variant_words(tokens: Column, model: Column, label: Column) -> Column:
    other = F.filter(tokens, lambda t: t.isin(*VARIANTS) & (t != model) & ~F.call_function("contains", label, t))
    pieces = F.flatten(F.transform(other, lambda t: F.when(t == "프로맥스", F.array(F.lit("프로"), F.lit("맥스"))).otherwise(F.array(t))))
    return F.array_distinct(F.filter(pieces, lambda t: ~F.call_function("contains", label, t)))


def product_name(keyword: Column, tokens: Column, text: Column) -> Column:
    """The name of a product by its route: accessory, canonical, or the joined tokens."""
    keyword = blank(keyword)
    model, storage = model_token(tokens), storage_token(tokens)
    label = model_label(keyword, model)
    base = F.array_join(F.concat(F.array(label), variant_words(tokens, model, label)), " ")
    words = accessory_words(tokens, text)
    plain = F.slice(F.filter(tokens, lambda t: (t != keyword) & ~F.array_contains(words, t) & ~t.isin(*ACCESSORY_BRANDS)), 1, 2)
    accessory = F.when(model.isNotNull(), F.concat_ws(" ", base, F.array_join(words, " "))).otherwise(F.array_join(F.filter(F.concat(F.array(keyword), plain, words), lambda x: x != ""), " "))
    return F.when(F.size(words) > 0, accessory).when(model.isNotNull(), F.concat_ws(" ", base, storage)).otherwise(F.array_join(tokens, " "))


def base_name(name: Column) -> Column:
    """A cluster's name without capacities at its end; one token stays."""
    return tidy(F.regexp_replace(tidy(blank(name)), rf"(?iU)(?<=\S)(?:\s+{CAPACITY})+$", ""))


#: Words of accessory clusters, capacities at the end of a cluster's name, and names that make listings alike, in the order in which they are looked for.
ACCESSORY_CLUSTER_WORDS = ("케이스", "필름", "강화유리", "유리", "충전기", "충전", "케이블", "젠더", "거치대", "파우치", "그립", "스트랩", "보호", "홀더", "스티커")
CAPACITY = r"\d+(?:gb|tb|기가|테라)"
ALIKE = (
    r"아이폰\s*\d+\s*(?:프로맥스|프로|max|plus|플러스|미니|mini|에어|air)?",
    r"iphone\s*\d+\s*(?:promax|pro|max|plus|mini|air)?",
    r"갤럭시\s*s\s*\d+\s*(?:울트라|플러스|plus)?",
    r"galaxy\s*s\s*\d+\s*(?:ultra|plus)?",
    r"(?<![a-z0-9])s\s*\d{2}\s*(?:울트라|플러스|plus)?",
    r"z\s*플립\s*\d+",
    r"z\s*폴드\s*\d+",
    r"(?<!\d)\d{2,4}\s*(?:gb|기가|g)(?!\d)",
    r"(?<!\d)(?:128|256|512|1024)\s*(?!\d)",
    r"(?<!\d)1\s*(?:tb|테라)(?!\d)",
)


def is_accessory_name(name: Column) -> Column:
    return blank(name).rlike("|".join(ACCESSORY_CLUSTER_WORDS))


def solid(text: Column) -> Column:
    """Lower-cased, without any white space."""
    return F.regexp_replace(F.lower(blank(text)), r"(?U)\s+", "")


def similarity_tokens(*texts: Column) -> Column:
    """The first three distinct names by which listings are alike, in the order of ``ALIKE``."""
    lower = F.lower(F.trim(F.concat_ws(" ", *map(blank, texts))))
    found = F.flatten(F.array(*(F.regexp_extract_all(lower, F.lit(f"(?U){p}"), F.lit(0)) for p in ALIKE)))
    return F.slice(F.array_distinct(F.filter(F.transform(found, solid), lambda t: t != "")), 1, 3)


#: Names and patterns of signs in titles that can matter for the model.
SIGN_PATTERNS = {
    "plus_symbol_or_word": r"(?i)(\+|＋|\bplus\b)",
    "slash_multiple_models": r"/",
    "hyphen_model_token": r"(?i)[0-9a-z가-힣]\s*[-–—]\s*[0-9a-z가-힣]",
    "parentheses_detail": r"[\(\)\[\]\{\}]",
    "inch_symbol": r"\d+(?:\.\d+)?\s*(?:\"|”|″|인치)",
    "storage_unit": r"(?i)\d+\s*(?:gb|g|tb)",
    "roman_generation": r"(?i)\b(?:i|ii|iii|iv|v)\b",
    "ampersand_bundle": r"&",
    "remaining_special_chars": r"[^0-9a-zA-Z가-힣\s]",
}


def sign_patterns(text: Column) -> Column:
    own = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*(F.when(own.rlike(f"(?U){p}"), F.lit(n)) for n, p in SIGN_PATTERNS.items())), lambda x: x.isNotNull())
