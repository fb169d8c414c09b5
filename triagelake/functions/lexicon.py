"""The domain pack: word lists, weights and patterns. Operators take them as parameters."""

from __future__ import annotations

LABELS = ("arama_kurtarma", "saglik", "barinma", "gida_su", "altyapi", "guvenlik", "lojistik", "psikolojik", "bilgi_paylasimi")
RARE = ("guvenlik", "psikolojik", "bilgi_paylasimi")
THRESHOLDS = {"arama_kurtarma": 0.5, "saglik": 0.45, "barinma": 0.5, "gida_su": 0.55, "altyapi": 0.4, "guvenlik": 0.6, "lojistik": 0.5, "psikolojik": 0.35, "bilgi_paylasimi": 0.5}

EMERGENCY = ("acil", "yardım", "enkaz", "imdat", "help")
LOCATION = ("sokak", "cadde", "mahalle", "konum", "adres")
AREA = ("çadır", "göçük", "yıkıntı", "heyelan", "bina")
URGENCY = {"critical": (3, ("acil", "imdat")), "trapped": (3, ("enkaz", "gocuk")), "medical": (2, ("hasta", "ilac", "ambulans")), "need": (1, ("battaniye", "cadir", "ekmek"))}
OFFICIAL = ("kriz_merkezi", "cadirkent", "yolbilgi")
ADDRESS = ("[\\p{L}]+ Mahallesi", "[\\p{L}]+ Caddesi", "[\\p{L}]+ Sokak", "No [0-9]+", "Kat [0-9]+", "[Dd]aire [0-9]+")
PLACE_PATTERNS = {"mahallesi": "([\\p{L}]+) Mahallesi", "ilcesi": "([\\p{L}]+) ilçesi"}
TEXT_TYPES = (("call", "yardım|acil|help"), ("announce", "duyuru|dikkat"), ("info", "bilgi|güncel"), ("status", "kapalı|açık|çöktü"))
WEAK = {
    "A": {
        "arama_kurtarma": ("enkaz", "göçük", "vinç", "ses geliyor"), "saglik": ("hasta", "ilac", "ambulans", "yaralı", "doktor"),
        "barinma": ("çadır", "battaniye", "baraka", "barınma"), "gida_su": ("ekmek", "içme suyu", "mama", "çorba", "yemek"),
        "altyapi": ("elektrik", "köprü", "yolunun", "doğalgaz", "baraj"), "guvenlik": ("hırsız", "yağma", "silah", "tehdit", "kavga"),
        "lojistik": ("kamyon", "depo", "forklift", "araç"), "psikolojik": ("korku", "ağlıyor", "titriyor", "psikolojik"),
    },
    "B": {
        "arama_kurtarma": ("enkazından", "göçükten"), "saglik": ("ambulans", "diyaliz"), "barinma": ("çadır",), "gida_su": ("içme suyu", "ekmek"),
        "altyapi": ("doğalgaz", "köprü"), "guvenlik": ("yağma", "silah"), "lojistik": ("forklift", "depo"), "psikolojik": ("ağlıyor",),
    },
}
INFO_WORDS = ("bilgi", "duyuru", "liste")
URGENT_WORDS = ("acil", "imdat", "enkaz")
HELP_WORDS = ("lütfen", "ne olur", "rica ederiz")
DOUBT_WORDS = ("teyitsiz", "söylenti", "doğrulanmadı")
# named rules: label -> (name, weight, pattern); negative weights lower the score
RARE_RULES = {
    "guvenlik": (("looting", 3, "yağma|hırsız"), ("weapon", 3, "silah"), ("dispute", 2, "kavga|tehdit"), ("watch", -1, "nöbet")),
    "psikolojik": (("crying", 3, "ağlıyor"), ("fear", 2, "kork|titri"), ("support", 2, "psikolojik|psikososyal"), ("game", -1, "oyun")),
    "bilgi_paylasimi": (("notice", 2, "duyuru|bilgi"), ("list", 1, "liste"), ("share", 1, "paylaş"), ("urgent", -2, "acil|imdat")),
}
INFO_SIGNALS = {"m": "liste|duyuru", "r": "açık|kapalı", "c": "saat|sabah", "a": "teyitli bilgi"}
INFO_MIN_PROB = 0.20
FOCUS = {"guvenlik": ("yağma", "silah", "kavga"), "psikolojik": ("ağlıyor", "kork")}
REGIONS = {"Marmara": (3, ("Kuzey", "Güney")), "Ege": (2, ("Kıyı",)), "İç": (1, ("Doğu", "Batı", "Orta"))}
PROBES = (
    ("rubble", "Enkaz altında ses geliyor, vinç lazım", ("arama_kurtarma",)), ("water", "İçme suyu ve ekmek bitti", ("gida_su",)),
    ("road", "Köprü tek yön, elektrik yok", ("altyapi",)), ("theft", "Yağma var, silah sesi duyuldu", ("guvenlik",)),
)
# overrides of candidates: label -> veto patterns with their names, and patterns that confirm
OVERRIDES = {
    "guvenlik": {"veto": (("guvenlik_unconfirmed", "teyitsiz|söylenti"), ("guvenlik_hashtag", "#(yağma|güvenlik)")), "strong": ("yağma|hırsız", "silah", "kavga")},
    "psikolojik": {"veto": (("psikolojik_profession", "spor psikolo"), ("psikolojik_game", "oyun")), "strong": ("ağlıyor", "kork", "psikolojik|psikososyal")},
    "bilgi_paylasimi": {"veto": (("bilgi_urgent", "acil|imdat"),), "strong": ("duyuru", "teyitli bilgi", "liste.*(açık|saat)|(açık|saat).*liste")},
}
SEVERITY_FLOOR = {"arama_kurtarma": 3, "saglik": 3, "guvenlik": 2, "barinma": 1, "gida_su": 1, "altyapi": 1, "lojistik": 1, "psikolojik": 1}
PROBES_10 = (
    *PROBES, ("medical", "Yaralı var, ambulans ve doktor bekliyoruz", ("saglik",)), ("shelter", "Çadır ve battaniye yok, barınma sorunu", ("barinma",)),
    ("transport", "Kamyon depo önünde, forklift araç gerek", ("lojistik",)), ("mind", "Çocuk korku içinde, ağlıyor ve titriyor", ("psikolojik",)),
    ("notice", "Duyuru: bilgi liste halinde", ("bilgi_paylasimi",)), ("none", "Bugün hava güneşli", ()),
)
