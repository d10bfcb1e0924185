"""Word lists and thresholds. All are parameters of the operators; these are the defaults and the bench lexicon."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results depend on these lists and numbers being exactly so.

#: (code, family, keywords), in the order that decides ties.
FRENCH_PATTERNS = (
    ("F01", "Rupture", "part partit quitte quitta"),
    ("F02", "Rupture", "voulut veut décide décida cherche chercha recherche"),
    ("F03", "Rupture", "manque manqua privé orphelin abandonné"),
    ("F10", "Quête", "rencontre rencontra arrive arriva trouve trouva"),
    ("F11", "Quête", "reçut reçoit donna donne offre"),
    ("F12", "Quête", "entra entre pénètre pénétra"),
    ("F20", "Obstacle", "frappe frappa attaque attaqua combat combattit"),
    ("F21", "Obstacle", "trahit trahison trahi"),
    ("F22", "Obstacle", "menace menaça"),
    ("F23", "Obstacle", "tue tua meurtre assassina"),
    ("F24", "Obstacle", "blessa blesse"),
    ("F30", "Pivot", "découvre découvrit comprend comprit apprend apprit"),
    ("F31", "Pivot", "révèle révéla avoue avoua"),
    ("F32", "Pivot", "cache cacha dissimule"),
    ("F40", "Résolution", "sauve sauva libère libéra"),
    ("F41", "Résolution", "triomphe vainqueur gagna gagne"),
    ("F42", "Résolution", "échoue échoua perdit"),
    ("F43", "Résolution", "meurt mourut mort"),
    ("F44", "Résolution", "pardonne pardonna"),
    ("F45", "Résolution", "vengea venge vengeance"),
    ("F50", "Liaison", "aime aima amour éprit"),
    ("F51", "Liaison", "épouse épousa mariage"),
    ("F52", "Liaison", "rejette rejeta refusa refuse"),
    ("FNBENI", "Liaison africaine", "bénit bénédiction"),
    ("FNMALA", "Obstacle africain", "maudit malédiction"),
    ("FNANC", "Pivot africain", "ancêtre ancêtres esprits rêve vision"),
    ("FNPROV", "Liaison africaine", "proverbe sagesse parole"),
    ("FNGR", "Liaison africaine", "griot conte raconta"),
    ("FNAL", "Liaison africaine", "alliance clan famille tribu"),
    ("FNCOMM", "Liaison africaine", "communauté assemblée village peuple"),
)
FRENCH_PHASES = (("Complication", ("mais", "cependant", "soudain", "or")), ("Climax", ("alors", "enfin", "moment")), ("Résolution", ("finalement", "ainsi", "depuis lors", "à la fin")))
FRENCH_HIGH = "combat guerre mort tue tua trahison blessa terrible horreur cri hurla sang douleur attaque fuir paniqua déchira"
FRENCH_LOW = "calme paix sereine doux lumineux heureux tranquille pardonna embrassa sourit"
#: "doit" counts twice.
FRENCH_MODALITIES = (("vouloir", "veut voulut désire désira souhaite souhaita rêve"), ("devoir", "doit dut faut fallut doit obligé promet promit"), ("pouvoir", "peut pouvait put parvient parvint réussit"), ("savoir", "sait savait sut apprend apprit découvrit comprit"))
FRENCH_VERBS = (
    "part partit quitte quitta voulut veut décida décide rencontre rencontra cherche chercha recherche frappe frappa attaque attaqua combat combattit "
    "tue tua blessa blesse menace menaça aime aima épouse épousa déteste détesta trahit promet promit accepte accepta refuse refusa "
    "découvre découvrit comprend comprit apprend apprit révèle révéla avoue avoua cache cacha meurt mourut sauve sauva libère libéra triomphe "
    "échoue échoua pardonne pardonna vengea venge bénit maudit prie invoqua offre arrive arriva entra entre sortit sort "
    "donna donne reçut reçoit prit prend vit voit entendit entend parla parle"
)
STOP_NAMES = (
    "Il Elle Ils Elles On Je Tu Nous Vous Un Une Des Le La Les Ce Cette Ces Mais Cependant Lorsque Quand Alors Ainsi Puis Ensuite Tout Tous Toute Toutes Aussi "
    "Après Avant Depuis Pour Avec Sans Sous Dans Sur Chez Par Voici Voilà Oui Non Car Donc Or Ni"
)
ROLES = ("protagoniste", "objet", "destinateur", "destinataire", "adjuvant", "opposant")
ROLE_WORD = "[a-zàâäéèêëïîôöùûüç]{3,}"
ROLE_STOPWORDS = "les des que qui son sont pour avec dans par sur cette ces ses leur leurs tout tous aucun aucune"
LENGTH_CATEGORIES = {"tres_court": 1, "court": 2, "moyen": 3, "long": 4, "tres_long": 5}
REGISTER_DISTANCE = (
    ("narratif_neutre", "didactique", 0.3), ("narratif_neutre", "poetique", 0.7), ("narratif_neutre", "lyrique", 0.7), ("narratif_neutre", "dramatique", 0.6),
    ("narratif_neutre", "comique", 0.5), ("narratif_neutre", "satirique", 0.5), ("narratif_neutre", "epique", 0.6), ("didactique", "poetique", 0.6),
    ("didactique", "satirique", 0.4), ("poetique", "lyrique", 0.2), ("poetique", "epique", 0.4), ("comique", "satirique", 0.3),
)
#: African codes on works of other traditions.
RECODED = {"FNPROV": "F49", "FNBENI": "F11", "FNMALA": "F47", "FNANC": "F31", "FNGR": "F32", "FNAL": "F51", "FNCOMM": "F49"}
RECODED_DEFAULT = "F49"
#: (family id, codes), in order.
REPERTOIRE = (
    ("F1", "F01 F02 F03 F04 F05 F06 F07"), ("F2", "F10 F11 F12 F13 F14 F15 F16"), ("F3", "F20 F21 F22 F23 F24 F25 F26 F27 F28"), ("F4", "F30 F31 F32 F33 F34 F35"),
    ("F5", "F40 F41 F42 F43 F44 F45 F46 F47 F48 F49"), ("F6", "F50 F51 F52 F53 F54 F55 F56"), ("FN", "FNAL FNANC FNBENI FNCOMM FNGR FNMALA FNPROV"),
)
FUNCTION_NAMES = {
    "F01": "Départ", "F02": "Désir / Quête", "F03": "Manque", "F04": "Interdiction", "F05": "Transgression", "F06": "Exil initial", "F07": "Mandat",
    "F10": "Rencontre", "F11": "Don / Réception", "F12": "Entrée dans l'épreuve", "F13": "Cheminement", "F14": "Reconnaissance du mentor", "F15": "Épreuve qualifiante", "F16": "Obtention du moyen",
    "F20": "Combat", "F21": "Trahison", "F22": "Menace", "F23": "Meurtre", "F24": "Blessure", "F25": "Enlèvement", "F26": "Duel ou compétition", "F27": "Poursuite", "F28": "Épreuve principale",
    "F30": "Reconnaissance", "F31": "Révélation", "F32": "Dissimulation", "F33": "Métamorphose", "F34": "Renversement", "F35": "Anagnorisis",
    "F40": "Libération / Sauvetage", "F41": "Triomphe", "F42": "Échec", "F43": "Mort", "F44": "Pardon", "F45": "Vengeance", "F46": "Rédemption", "F47": "Punition", "F48": "Récompense", "F49": "Sentence morale",
    "F50": "Amour", "F51": "Union / Mariage", "F52": "Rejet", "F53": "Séparation", "F54": "Retour", "F55": "Héritage", "F56": "Filiation",
    "FNAL": "Alliance matrimoniale / clanique", "FNANC": "Ancêtre-arbitre", "FNBENI": "Bénédiction", "FNCOMM": "Interpellation communautaire", "FNGR": "Griot-narrateur", "FNMALA": "Malédiction", "FNPROV": "Proverbe narratif",
}
#: plan: (per day, per month); plans of other names are starter.
PLANS = {"starter": (20, 200), "pro": (120, 2000), "enterprise": (1000, 20000)}
#: model class: USD per million tokens of input, output, cache read; other names cost as "standard".
PRICES = {"standard": (3.0, 15.0, 0.3), "large": (15.0, 75.0, 1.5), "small": (1.0, 5.0, 0.1)}

#: One keyword for each language of the driver's pseudo-words, with the families of FRENCH_PATTERNS.
BENCH_KEYWORDS = {
    "F01": "as par nicht para", "F02": "be dans ist una", "F03": "by au dem al", "F10": "this pas im ción", "F11": "are sur ein do", "F12": "at avec eine lo",
    "F20": "er eau als os", "F21": "from ai sch ci", "F22": "th oi te ar", "F23": "ha ment ung ra", "F24": "an on ie ue",
    "F30": "re ier ge ado", "F31": "nd eux ber ll", "F32": "he tre ver mi", "F40": "es elle ench rr", "F41": "en ch heit ta", "F42": "ed aux pf co", "F43": "or éeau keit ga", "F44": "ti ré enau mente", "F45": "ing pa ach ciónue",
    "F50": "ea éai ente ciónos", "F51": "st éé enen ciónas", "F52": "nt vi enst bo",
    "FNBENI": "ly éan ersch ciónción", "FNMALA": "ou éè enbe ciónque", "FNANC": "ble éle enein ciónado", "FNPROV": "sh éque lich ciónñ", "FNGR": "ther éê enge ññ", "FNAL": "tion éeux enie ciónci", "FNCOMM": "wh éç tz ciónco",
}


@dataclass(frozen=True)
class Lexicon:
    """patterns: (code, family, keywords); phases: (phase, words), tried in order; modalities: (name, words)."""

    patterns: tuple[tuple[str, str, tuple[str, ...]], ...]
    phases: tuple[tuple[str, tuple[str, ...]], ...]
    high: tuple[str, ...]
    low: tuple[str, ...]
    modalities: tuple[tuple[str, tuple[str, ...]], ...]
    verbs: tuple[str, ...]
    stop_names: tuple[str, ...] = field(default=tuple(STOP_NAMES.split()))

    def codes(self) -> dict[str, list[int]]:
        """Pattern positions of each keyword."""
        found: dict[str, list[int]] = {}
        for k, (_, _, words) in enumerate(self.patterns):
            for w in words:
                found.setdefault(w, []).append(k)
        return found


def _split(pairs):
    return tuple((a, tuple(b.split())) for a, b in pairs)


FRENCH = Lexicon(tuple((c, f, tuple(w.split())) for c, f, w in FRENCH_PATTERNS), FRENCH_PHASES, tuple(FRENCH_HIGH.split()), tuple(FRENCH_LOW.split()), _split(FRENCH_MODALITIES), tuple(FRENCH_VERBS.split()))
BENCH = Lexicon(
    tuple((c, f, tuple(BENCH_KEYWORDS[c].split())) for c, f, _ in FRENCH_PATTERNS),
    (("Complication", ("thth", "fr", "de", "ciónes")), ("Climax", ("thon", "éré", "ensch", "ciónra")), ("Résolution", ("than", "éai", "ener", "ñes"))),
    ("thhe", "thre", "èai", "èle", "enung", "erung", "ciónll", "ja"),
    ("thha", "thnt", "éen", "éon", "enlich", "enver", "asción", "cióndo"),
    _split((("vouloir", "thed éou"), ("devoir", "ément éch ément"), ("pouvoir", "enheit erch"), ("savoir", "ciónar thon"))),
    tuple("the of and de la le des der die und que el los par as by th en es re".split()),
)
