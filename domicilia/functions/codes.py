"""Code lists of the survey.

Fixed values: codes, labels and their spelling come from the questionnaire's
published dictionary and must be kept as they are.
"""

REGIONS = {
    1: "Plano Piloto",
    2: "Gama",
    3: "Taguatinga",
    4: "Brazlândia",
    5: "Sobradinho",
    6: "Planaltina",
    7: "Paranoá",
    8: "Núcleo Bandeirante",
    9: "Ceilândia",
    10: "Guará",
    11: "Cruzeiro",
    12: "Samambaia",
    13: "Santa Maria",
    14: "São Sebastião",
    15: "Recanto das Emas",
    16: "Lago Sul",
    17: "Riacho Fundo",
    18: "Lago Norte",
    19: "Candangolândia",
    20: "Águas Claras",
    21: "Riacho Fundo II",
    22: "Sudoeste/Octogonal",
    23: "Varjão",
    24: "Park Way",
    25: "SCIA/Estrutural",
    26: "Sobradinho II",
    27: "Jardim Botânico",
    28: "Itapoã",
    29: "SIA",
    30: "Vicente Pires",
    31: "Fercal",
    32: "Sol Nascente/Pôr do Sol",
    33: "Arniqueira",
}

SECTORS = {
    53011: "Asa Norte",
    53012: "Asa Sul",
    53013: "Noroeste",
    53014: "Demais",
    53020: "Gama",
    53030: "Taguatinga",
    53040: "Brazlândia",
    53050: "Sobradinho",
    53060: "Planaltina",
    53070: "Paranoá",
    53080: "Núcleo Bandeirante",
    53090: "Ceilândia",
    53100: "Guará",
    53110: "Cruzeiro",
    53120: "Samambaia",
    53130: "Santa Maria",
    53140: "São Sebastião",
    53150: "Recanto Das Emas",
    53160: "Lago Sul",
    53170: "Riacho Fundo",
    53180: "Lago Norte",
    53190: "Candangolândia",
    53200: "Águas Claras",
    53210: "Riacho Fundo II",
    53220: "Sudoeste/Octogonal",
    53230: "Varjão",
    53240: "Park Way",
    53250: "SCIA-Estrutural",
    53260: "Sobradinho II",
    53271: "Jardim Botânico - Tradicional",
    53272: "Jardim Mangueiral",
    53280: "Itapoã",
    53290: "SIA",
    53300: "Vicente Pires",
    53310: "Fercal",
    53320: "Sol Nascente/Pôr do Sol",
    53330: "Arniqueira",
}

MONTHS = {
    1: "janeiro",
    2: "fevereiro",
    3: "março",
    4: "abril",
    5: "maio",
    6: "junho",
    7: "julho",
    8: "agosto",
    9: "setembro",
    10: "outubro",
    11: "novembro",
    12: "dezembro",
}

# Polygon labels that differ from the region list.
POLYGON_LABELS = {"Pôr do Sol": "Sol Nascente/Pôr do Sol", "SCIA": "SCIA/Estrutural"}

GENDER = {1: "Masculino", 2: "Feminino"}
RACE = {1: "Branca", 2: "Negra", 3: "Amarela", 4: "Negra", 5: "Indígena"}
LOT_STATUS = {1: "regularizado", 2: "não regularizado", 88: "não sabe"}

# Sentinels found inside money columns.
UNKNOWN, REFUSED = 77777, 88888
NOT_APPLICABLE, NO_INCOME = 66666, 99999

LABOUR_INCOME = ["G16", "G19"]
OTHER_INCOME = ["G201", "G202", "G203", "G204"]

DOMESTIC_STAFF = [17, 18]

MINIMUM_WAGE = 954
RENT_SHARE = 0.3
CROWDING_LIMIT = 3

# First subclass of the price index used for incomes, and the one for rents.
GENERAL_INDEX, RENT_INDEX = 7169, 7448

# Closed upper limits; the first class has no lower one.
DEMAND_LIMITS = [0, 2000, 4000, 6000, 8000, 10000]
DEMAND_CLASSES = [
    "sem dados",
    "0-2000",
    "2000-4000",
    "4000-6000",
    "6000-8000",
    "8000-10000",
    "+10000",
]

INCOME_LIMITS = [1800, 2600, 4000, 9000]
INCOME_BANDS = [
    "Até R$1800",
    "Entre R$1801 e R$2600",
    "Entre R$2601 e R$4000",
    "Entre R$4001 e R$9000",
    "Maior que R$9000",
]

AGE_BANDS = {"24 a 29": (24, 29), "30 a 39": (30, 39), "40 a 64": (40, 64)}

HEAD, NOT_HEAD = "Chefe", "não chefe"

RUSTIC, IMPROVISED = "domicílio rústico", "domícílio improvisado"
FAMILIES, ROOM, OTHER = "Famílias conviventes", "Cômodo", "Demais"
FLAT, HOUSE = "Apartamento+quitinete+cômodo", "Casa"

# Labels of a dwelling by the components it has. Several components: the first
# pair in the list that it has gives the label.
ALL_COMPONENTS, NO_COMPONENT = "todos", "nenhum"
SINGLE_LABELS = {
    "habit_prec": "Precariedade",
    "cohabit_familiar": "coabitacao",
    "onus_aluguel": "onus",
    "adens": "adensamento",
}
PAIR_LABELS = [
    ("cohabit_familiar", "onus_aluguel", "Coabitacao e onus"),
    ("cohabit_familiar", "adens", "Coabitacao e adensamento"),
    ("onus_aluguel", "adens", "onus e adensamento"),
    ("habit_prec", "cohabit_familiar", "precariedade e coabitacao"),
    ("habit_prec", "onus_aluguel", "precariedade e onus"),
    ("habit_prec", "adens", "precariedade e adensamento"),
]
PAIR_LABELS_LEGACY = [
    ("habit_prec", "cohabit_familiar", "precariedade e coabitacao"),
    ("habit_prec", "onus_aluguel", "precariedade e onus"),
    ("habit_prec", "adens", "precariedade e onus"),
    ("cohabit_familiar", "onus_aluguel", "Coabitacao e onus"),
    ("cohabit_familiar", "adens", "Coabitacao e adensamento"),
    ("onus_aluguel", "adens", "onus e adensamento"),
]

NO_DEFICIT = "sem deficit"
DOMINANT = {
    "adensamento": "adensamento",
    "Coabitacao e adensamento": "adensamento",
    "onus e adensamento": "adensamento",
    "precariedade e adensamento": "adensamento",
    "coabitacao": "coabitacao",
    "Coabitacao e onus": "coabitacao",
    "precariedade e coabitacao": "coabitacao",
    "onus": "onus",
    "precariedade e onus": "onus",
    "Precariedade": "Precariedade",
}

TOTAL_LABEL = "DF"
