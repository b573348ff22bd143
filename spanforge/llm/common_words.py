"""The commonest function words of the languages handled, by language."""

from __future__ import annotations

COMMON = {
    "en": "the a an of in to and is are was were this that these with for on at by we it its as from after before not but who which if than or be has had does no each",
    "de": "der die das den dem des ein eine einer und in im zu zur mit für auf bei von nach ist nicht oder als durch ohne trotz um am über für während laut",
    "fr": "le la les l d un une des du de et en à au aux pour dans par sur est ne que qui ce cette avec après selon dès malgré près",
    "es": "el la los las un una de del y en a al por para con que se es no su según sin durante esta este cada",
    "pt": "o a os as um uma de do da dos das e em no na para por com que não se às até após esta também segundo",
    "ru": "и в во на не с со к у по за из от для до без при после о об это эта этот эти что как но или же его её их мы он она они также поэтому однако затем кроме того тем если когда то т е см рис гл г ок",
    "el": "ο η το οι τα του της των τον την τη στο στη στην και σε με για από χωρίς μετά κατά π χ",
    "hi": "का की के को में से है हैं और यह ने पर तक बाद भी एक लगभग अनुसार",
    "ar": "في من على إلى هذا هذه بعد دون بدون عن مع و حسب نحو",
    "zh": "的 了 在 是 和 这 该 后 吗 之",
    "ja": "の は を に が で と た し する",
    "th": "ของ ใน และ ที่ โดย ไม่ มี หลัง การ นี้",
}
SPACED = frozenset(w for lang, words in COMMON.items() if lang not in ("zh", "ja", "th") for w in words.split())
UNSPACED = {lang: tuple(COMMON[lang].split()) for lang in ("zh", "ja", "th")}
