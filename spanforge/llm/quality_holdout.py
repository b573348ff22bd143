"""Small documents whose kind was checked by hand: HOLDOUT calibrates the trees and is never fitted on;
EXAMPLES stand in for a kind that is missing from the data, and calibrate nothing."""

from __future__ import annotations

_EN = "The council met on Tuesday to discuss the new bridge. It was agreed that work should begin\nin spring, before the river rises. Nobody spoke against the plan, but two members asked\nfor a second survey of the northern bank."
_DE = "Der Zug hielt auf offener Strecke, weil ein Baum auf den Gleisen lag. Nach einer Stunde\nkonnten die Reisenden aussteigen. Für den Abend waren Busse bestellt, die nicht kamen."
_FR = "Le moulin a été construit par trois frères au bord de la rivière. Il n’a jamais servi,\ncar le courant était trop faible en été. On le visite encore le dimanche."
_ES = "La casa estaba cerrada desde el invierno. Los vecinos no sabían si los dueños volverían,\ny el jardín se había llenado de hierba. En mayo llegó una carta."
_RU = "Старый маяк не работал с осени. Смотритель приехал в город и попросил прислать мастера,\nно дороги уже занесло снегом. До весны корабли обходили мыс стороной."
_PT = "A ponte foi aberta ao trânsito em março. Os moradores da margem norte esperavam por ela\nhá vinte anos, mas não houve festa. Choveu durante todo o dia."
_EL = "Το πλοίο έφτασε στο λιμάνι το πρωί. Οι επιβάτες περίμεναν πολλές ώρες, γιατί η σκάλα\nείχε χαλάσει. Κανείς δεν παραπονέθηκε στον καπετάνιο."
_ZH = "昨天下午，村里的老师带着孩子们去了河边。他们在那里看到了很多鸟，还有一座旧的木桥。\n回来的路上下起了雨，大家都没有带伞。"
_JA = "駅の前に小さな本屋がある。毎朝、店の人は早くから掃除をしている。\n雨の日でも客は来る。古い地図を探す人が多い。"
_HI = "गाँव के पास एक पुराना पुल है। बरसात में नदी का पानी बहुत बढ़ जाता है और लोग पुल से नहीं जाते।\nइस साल नया पुल बन गया है।"
_AR = "وصل القطار إلى المحطة في الصباح. كان الناس ينتظرون منذ ساعات، ولم يكن هناك مكان للجلوس.\nبعد الظهر عاد الجميع إلى بيوتهم."
_TH = "เมื่อวานนี้ฝนตกหนักมากในหมู่บ้าน ชาวบ้านต้องขนของขึ้นที่สูง\nแม่น้ำล้นตลิ่งในตอนกลางคืน ไม่มีใครได้รับบาดเจ็บ"

_PROSE = [_EN, _DE, _FR, _ES, _RU, _PT, _EL, _ZH, _JA, _HI, _AR, _TH, _EN + "\n\n" + _EN + "\n\nSee also:\n• River works\n• Bank repair", _DE + "\n" + _DE + "\n\nJahr Menge\n1999 20.5\n2000 31.0", "It rained all day, and the road was closed."]
_LISTS = [
    "1) Bread\n2) Salted butter\n3) Smoked fish\n4) Dried apples\n5) Oats",
    "• Die Brücke\n• Der Turm\n• Das Tor\n• Die Mauer",
    "– La gare (Lyon)\n– Le port (Brest)\n– Le pont (Tours)\n– La tour (Nantes)",
    "Preface ............ 1\nThe harbour ............ 7\nThe lower town ........ 19\nNotes ......... 44",
    "Bridge, 14, 20, 88-90\nCanal, 3, 51\nFerry, 9, 77, 101-102\nLock, 16",
    "[1] Marsh T., Hill R.. On tides, Leeds, 1984.\n[2] Ode K.. Weirs of the south, York, 1991.\n[3] Penn A.. Old mills, Bath, 2003.",
    "a) El puente: Ana Ruiz\nb) La torre: Luis Mora\nc) El molino: Eva Paz",
    "• Река\n• Мост через канал\n• Старая мельница\n• Новый порт\n• Дорога",
]
_TABLES = [
    "Year Mean Max Min\n1999 20.4 31.0 4.2\n2000 19.8 30.1 3.9\n2001 21.2 33.7 5.0",
    "Depth: 20.2 m\nWidth: 11.7 m\nSlope: 3.1 %\nFlow: 18.0 kg",
    "Item A B C\nX-101 yes no yes\nX-102 no no n/a\nX-103 + – yes",
    "Leeds 14,201 9,112 8,800\nYork 11,023 7,761 6,540\nBath 9,430 5,128 4,999",
    "Start Goal Length\n07:10 Leeds York 41 km A\n08:25 York Bath 322 km B\n09:00 Bath Leeds 318 km A",
    "2011 12 14 19 22\n2012 11 15 18 27\n2013 9 13 20 25",
]
_JUNK = [
    "3f a0 11 9c 7e 02 bb\n1d 44 e9 0a c7 5f\n90 12 ab 3e 77",
    "zqx vkjw mprt xxlk qwzj\nvbnk trrk pllz wqx\nkzzv mnxq rtvw",
    "ehT licnuoc tem no yadseuT ot ssucsid eht wen egdirb\n.egdirb wen eht ssucsid ot yadseuT no tem licnuoc ehT\n.gnirps ni nigeb dluohs krow taht deerga saw tI",
    "  \n ",
    "■ □ ■ ■ □ ■\n_ _ _ _ _ _ _\n|||| || | |||",
    "'&Y2?.30)a3$b)=~#(%:$%@((1/+*(#;&>2%/>()|^}\n{}~!;,((&^%$#@!)){}[]<>?/",
    "eTh cnuiocl emt no usTydae ot isdsucs hte nwe ibdrge\nti wsa ergade ttah rwok sohuld ebnig ni prsngi",
]

HOLDOUT: list[tuple[str, list[str]]] = [(k, t.split("\n")) for k, texts in (("prose", _PROSE), ("list", _LISTS), ("table", _TABLES), ("junk", _JUNK)) for t in texts]

_MORE = {
    "prose": ["The mill by the weir was sold in autumn. Its new owner, who came from the coast, wanted to\ngrind barley there again. The wheel had to be built anew, and the work took two years.", "Im Hafen lagen nur drei Boote. Der Sturm hatte am Abend begonnen, und niemand wollte\nhinaus. Erst am Morgen wurde es still.", "Les enfants jouaient dans la cour. Il faisait froid, mais personne ne voulait rentrer.\nLe maître les appela deux fois."],
    "list": ["1. Rope\n2. Two lanterns\n3. Tar\n4. Nails\n5. Canvas", "Ropes, 3, 17, 40-41\nSails, 8, 22\nTar, 19, 55-57\nTimber, 2, 61", "Opening .......... 2\nThe docks .......... 9\nThe yard .......... 31", "[1] Berg A.. Notes on rope, Hull, 1970.\n[2] Lund B.. Tar and timber, Bergen, 1988.", "• Segel\n• Anker\n• Ruder\n• Mast"],
    "table": ["Month Rain Wind\nJan 80.1 12.0\nFeb 64.7 11.3\nMar 51.0 9.8", "Length: 14.5 m\nBeam: 4.1 m\nDraught: 2.0 m", "K-201 yes no 1.0\nK-202 no no 0.5\nK-203 yes yes n/a"],
    "junk": ["a9 3c 77 e0 1b\n4f 02 dd 98 61 c3\n7a 11 b5", "tnuom eht no dellaf niar ehT\n.thgin lla deyats ti dna", "qjx zzkv wrrp lkmt\nvvxq jjkz pwtl mrrx\nkxzq tvrw", "- - - -- - -\n■ ■ □ ■ □\n0 0 0 0 0 00"],
}

EXAMPLES: list[tuple[str, list[str]]] = [(k, t.split("\n")) for k, texts in _MORE.items() for t in texts]
