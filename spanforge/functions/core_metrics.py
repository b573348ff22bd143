"""Widths of the fourteen standard fonts, in thousandths of an em.

Accented letters are as wide as their base letter but for the few listed; what the fonts list
outside ASCII is given once for each family.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

from .glyph_names import ASCII_NAMES, OTHER_NAMES, glyph_names, zapf_codes

_N = lambda s: [int(x) for x in s.split()]
# Widths of codes 32 to 126 of the standard encoding.
ASCII_WIDTHS = {
    "Helvetica": _N("278 278 355 556 556 889 667 222 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 222 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"),
    "Helvetica-Bold": _N("278 333 474 556 556 889 722 278 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 278 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"),
    "Times-Roman": _N("250 333 408 500 500 833 778 333 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"),
    "Times-Bold": _N("250 333 555 500 500 1000 833 333 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520"),
    "Times-Italic": _N("250 333 420 500 500 833 778 333 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541"),
    "Times-BoldItalic": _N("250 389 555 500 500 833 778 333 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570"),
}
# The codes of the standard encoding above 126, and the glyphs at them.
HIGH_CODES = [*range(161, 176), *range(177, 181), *range(182, 190), 191, *range(193, 201), 202, 203, 205, 206, 207, 208, 225, 227, 232, 233, 234, 235, 241, 245, 248, 249, 250, 251]
HIGH_NAMES = (
    "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl endash dagger daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright "
    "guillemotright ellipsis perthousand questiondown grave acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron emdash AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls"
).split()
HIGH_WIDTHS = {
    "Helvetica": _N("333 556 556 167 556 556 556 556 191 333 556 333 333 500 500 556 556 556 278 537 350 222 333 333 556 1000 1000 611 333 333 333 333 333 333 333 333 333 333 333 333 333 1000 1000 370 556 778 1000 365 889 278 222 611 944 611"),
    "Helvetica-Bold": _N("333 556 556 167 556 556 556 556 238 500 556 333 333 611 611 556 556 556 278 556 350 278 500 500 556 1000 1000 611 333 333 333 333 333 333 333 333 333 333 333 333 333 1000 1000 370 611 778 1000 365 889 278 278 611 944 611"),
    "Times-Roman": _N("333 500 500 167 500 500 500 500 180 444 500 333 333 556 556 500 500 500 250 453 350 333 444 444 500 1000 1000 444 333 333 333 333 333 333 333 333 333 333 333 333 333 1000 889 276 611 722 889 310 667 278 278 500 722 500"),
    "Times-Bold": _N("333 500 500 167 500 500 500 500 278 500 500 333 333 556 556 500 500 500 250 540 350 333 500 500 500 1000 1000 500 333 333 333 333 333 333 333 333 333 333 333 333 333 1000 1000 300 667 778 1000 330 722 278 278 500 722 556"),
    "Times-Italic": _N("389 500 500 167 500 500 500 500 214 556 500 333 333 500 500 500 500 500 250 523 350 333 556 556 500 889 1000 500 333 333 333 333 333 333 333 333 333 333 333 333 333 889 889 276 556 722 944 310 667 278 278 500 667 500"),
    "Times-BoldItalic": _N("389 500 500 167 500 500 500 500 278 500 500 333 333 556 556 500 500 500 250 500 350 333 500 500 500 1000 1000 500 333 333 333 333 333 333 333 333 333 333 333 333 333 1000 944 266 611 722 944 300 722 278 278 500 722 500"),
}
# Glyphs outside the standard encoding that are not as wide as a base letter.
LOOSE_NAMES = "divide commaaccent copyright lozenge Thorn dcaron threesuperior multiply partialdiff plusminus brokenbar registered summation greaterequal Eth tcaron Delta thorn twosuperior mu threequarters lcaron trademark onehalf lessequal onequarter degree radical minus logicalnot notequal eth onesuperior Euro Dcroat dcroat".split()
LOOSE_WIDTHS = {
    "Helvetica": _N("584 250 737 471 667 643 333 584 476 584 260 737 600 549 722 317 612 556 333 556 834 299 1000 834 549 834 400 453 584 584 549 556 333 556 722 556"),
    "Helvetica-Bold": _N("584 250 737 494 667 743 333 584 494 584 280 737 600 549 722 389 612 611 333 611 834 400 1000 834 549 834 400 549 584 584 549 611 333 556 722 611"),
    "Times-Roman": _N("564 250 760 471 556 588 300 564 476 564 200 760 600 549 722 326 612 500 300 500 750 344 980 750 549 750 400 453 564 564 549 500 300 500 722 500"),
    "Times-Bold": _N("570 250 747 494 611 672 300 570 494 570 220 747 600 549 722 416 612 556 300 556 750 394 1000 750 549 750 400 549 570 570 549 500 300 500 722 556"),
    "Times-Italic": _N("675 250 760 471 611 544 300 675 476 675 275 760 600 549 722 300 612 500 300 500 750 300 980 750 549 750 400 453 675 675 549 500 300 500 722 500"),
    "Times-BoldItalic": _N("570 250 747 494 611 608 300 570 494 570 220 747 600 549 722 366 612 500 300 576 750 382 1000 750 549 750 400 549 606 606 549 500 300 500 722 500"),
}
# Code, width and name of the glyphs of the symbol font.
SYMBOL = (
    "32:250:space 33:333:exclam 34:713:universal 35:500:numbersign 36:549:existential 37:833:percent 38:778:ampersand 39:439:suchthat 40:333:parenleft 41:333:parenright 42:500:asteriskmath 43:549:plus 44:250:comma 45:549:minus 46:250:period 47:278:slash "
    "48:500:zero 49:500:one 50:500:two 51:500:three 52:500:four 53:500:five 54:500:six 55:500:seven 56:500:eight 57:500:nine 58:278:colon 59:278:semicolon 60:549:less 61:549:equal 62:549:greater 63:444:question 64:549:congruent 65:722:Alpha 66:667:Beta "
    "67:722:Chi 68:612:Delta 69:611:Epsilon 70:763:Phi 71:603:Gamma 72:722:Eta 73:333:Iota 74:631:theta1 75:722:Kappa 76:686:Lambda 77:889:Mu 78:722:Nu 79:722:Omicron 80:768:Pi 81:741:Theta 82:556:Rho 83:592:Sigma 84:611:Tau 85:690:Upsilon 86:439:sigma1 "
    "87:768:Omega 88:645:Xi 89:795:Psi 90:611:Zeta 91:333:bracketleft 92:863:therefore 93:333:bracketright 94:658:perpendicular 95:500:underscore 96:500:radicalex 97:631:alpha 98:549:beta 99:549:chi 100:494:delta 101:439:epsilon 102:521:phi 103:411:gamma "
    "104:603:eta 105:329:iota 106:603:phi1 107:549:kappa 108:549:lambda 109:576:mu 110:521:nu 111:549:omicron 112:549:pi 113:521:theta 114:549:rho 115:603:sigma 116:439:tau 117:576:upsilon 118:713:omega1 119:686:omega 120:493:xi 121:686:psi 122:494:zeta "
    "123:480:braceleft 124:200:bar 125:480:braceright 126:549:similar 160:750:Euro 161:620:Upsilon1 162:247:minute 163:549:lessequal 164:167:fraction 165:713:infinity 166:500:florin 167:753:club 168:753:diamond 169:753:heart 170:753:spade 171:1042:arrowboth "
    "172:987:arrowleft 173:603:arrowup 174:987:arrowright 175:603:arrowdown 176:400:degree 177:549:plusminus 178:411:second 179:549:greaterequal 180:549:multiply 181:713:proportional 182:494:partialdiff 183:460:bullet 184:549:divide 185:549:notequal "
    "186:549:equivalence 187:549:approxequal 188:1000:ellipsis 189:603:arrowvertex 190:1000:arrowhorizex 191:658:carriagereturn 192:823:aleph 193:686:Ifraktur 194:795:Rfraktur 195:987:weierstrass 196:768:circlemultiply 197:768:circleplus 198:823:emptyset "
    "199:768:intersection 200:768:union 201:713:propersuperset 202:713:reflexsuperset 203:713:notsubset 204:713:propersubset 205:713:reflexsubset 206:713:element 207:713:notelement 208:768:angle 209:713:gradient 210:790:registerserif 211:790:copyrightserif "
    "212:890:trademarkserif 213:823:product 214:549:radical 215:250:dotmath 216:713:logicalnot 217:603:logicaland 218:603:logicalor 219:1042:arrowdblboth 220:987:arrowdblleft 221:603:arrowdblup 222:987:arrowdblright 223:603:arrowdbldown 224:494:lozenge "
    "225:329:angleleft 226:790:registersans 227:790:copyrightsans 228:786:trademarksans 229:713:summation 230:384:parenlefttp 231:384:parenleftex 232:384:parenleftbt 233:384:bracketlefttp 234:384:bracketleftex 235:384:bracketleftbt 236:494:bracelefttp "
    "237:494:braceleftmid 238:494:braceleftbt 239:494:braceex 241:329:angleright 242:274:integral 243:686:integraltp 244:686:integralex 245:686:integralbt 246:384:parenrighttp 247:384:parenrightex 248:384:parenrightbt 249:384:bracketrighttp "
    "250:384:bracketrightex 251:384:bracketrightbt 252:494:bracerighttp 253:494:bracerightmid 254:494:bracerightbt -1:790:apple"
)
# Widths of the dingbats, by runs of codes from the one that starts the run.
ZAPF_RUNS = {
    32: _N("278 974 961 974 980 719 789 790 791 690 960 939 549 855 911 933 911 945 974 755 846 762 761 571 677 763 760 759 754 494 552 537 577 692 786 788 788 790 793 794 816 823 789 841 823 833 816 831 923 744 723 749 790 792 695 776 768 792 759 707 708 682 701 826 815 789 789 707 687 696 689 786 787 713 791 785 791 873 761 762 762 759 759 892 892 788 784 438 138 277 415 392 392 668 668"),
    128: _N("390 390 317 317 276 276 509 509 410 410 234 234 334 334"),
    161: _N("732 544 544 910 667 760 760 776 595 694 626"),
    172: [788] * 40,
    212: _N("894 838 1016 458 748 924 748 918 927 928 928 834 873 828 924 924 917 930 931 463 883 836 836 867 867 696 696 874"),
    241: _N("874 760 946 771 865 771 888 967 888 831 873 927 970 918"),
}
FAMILY = {
    "Helvetica": "Helvetica", "Helvetica-Oblique": "Helvetica", "Helvetica-Bold": "Helvetica-Bold", "Helvetica-BoldOblique": "Helvetica-Bold",
    "Times-Roman": "Times-Roman", "Times-Bold": "Times-Bold", "Times-Italic": "Times-Italic", "Times-BoldItalic": "Times-BoldItalic",
}
COURIER = ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique")
CORE_FONTS = (*FAMILY, *COURIER, "Symbol", "ZapfDingbats")
# The letters each accent stands on in the text fonts, beyond the standard encoding, and what isn't as wide as its letter.
ACCENTED = {
    "acute": "AaCcEeIiLlNnOoRrSsUuYyZz", "grave": "AaEeIiOoUu", "circumflex": "AaEeIiOoUu", "tilde": "AaNnOo", "dieresis": "AaEeIiOoUuYy", "ring": "AaUu", "caron": "CcDEeLNnRrSsTZz", "cedilla": "CcSs", "breve": "AaGg",
    "macron": "AaEeIiOoUu", "ogonek": "AaEeIiUu", "dotaccent": "EeIZz", "hungarumlaut": "OoUu", "commaaccent": "GKkLlNnRrSsTtg",
}
ODD_WIDTHS = {("Times-Italic", "Lcaron"): 611}


@lru_cache(32)
def core_font(name: str) -> tuple[tuple[int, int, str], ...] | None:
    """(code or -1, width, glyph name) of a standard font, matched by its exact name; else None."""
    if name == "Symbol":
        return tuple((int(a), int(b), c) for a, b, c in (x.split(":") for x in SYMBOL.split()))
    if name == "ZapfDingbats":
        return tuple((start + i, w, f"zapf{start + i}") for start, ws in ZAPF_RUNS.items() for i, w in enumerate(ws))
    if name in COURIER:
        std = core_font("Helvetica")
        return tuple((code, 600, glyph) for code, _, glyph in std)
    family = FAMILY.get(name)
    if family is None:
        return None
    low = [{"quotesingle": "quoteright", "grave": "quoteleft"}.get(n, n) for n in ASCII_NAMES]
    out = [(32 + i, w, n) for i, (w, n) in enumerate(zip(ASCII_WIDTHS[family], low))]
    out += list(zip(HIGH_CODES, HIGH_WIDTHS[family], HIGH_NAMES))
    width = {n: w for _, w, n in out}
    loose = dict(zip(LOOSE_NAMES, LOOSE_WIDTHS[family]))
    out += [(-1, w, n) for n, w in loose.items()]
    for accent, letters in ACCENTED.items():
        for c in letters:
            base = width["dotlessi"] if c == "i" and accent != "ogonek" else width[c]
            out.append((-1, ODD_WIDTHS.get((family, c + accent), base), c + accent))
    return tuple(out)


def load_afm(folder: str, name: str) -> tuple[tuple[int, int, str], ...] | None:
    """Metrics from a published AFM file ``folder/name.afm``, for those who have them at hand."""
    path = os.path.join(folder, name + ".afm")
    if not os.path.exists(path):
        return None
    with open(path, encoding="latin-1") as f:
        return tuple((int(m[1]), round(float(m[2])), m[3]) for m in re.finditer(r"^C\s+(-?\d+)\s*;\s*WX\s+([\d.]+)\s*;\s*N\s+(\S+)", f.read(), re.M))


def glyph_code_point(font: str, code: int, name: str) -> int:
    """The character of a glyph of a standard font, 0 if it has none."""
    if font == "ZapfDingbats":
        return zapf_codes().get(code, 0)
    return glyph_names().get(name, OTHER_NAMES.get(name, 0))
