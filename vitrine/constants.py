"""Vocabularies, labels and formats that define the results."""

# Master categories, in matching order.
MASTER_CATEGORIES = [
    "Perfumaria", "Maquiagem", "Corpo e Banho", "Cabelos", "Skincare", "Infantil",
    "Masculino", "Unhas", "Acessórios", "Kits e Presentes", "Proteção Solar", "Desodorantes",
]

# Synonyms of each master category, in matching order.
CATEGORY_SYNONYMS = {
    "Perfumaria": [
        "Perfumes", "Fragrâncias", "Eau de Parfum", "Eau de Toilette", "Colônia", "Deo Parfum",
        "Body Spray",
    ],
    "Maquiagem": [
        "Make", "Make-up", "Makeup", "Cosméticos", "Batom", "Base", "Blush", "Sombra", "Máscara",
        "Delineador", "Corretivo", "Pó", "Primer", "Iluminador", "Contorno", "Lábios", "Olhos",
        "Rosto",
    ],
    "Corpo e Banho": [
        "Corpo", "Banho", "Hidratação", "Hidratante", "Loção", "Creme Corporal", "Body Lotion",
        "Óleo Corporal", "Esfoliante", "Sabonete", "Shower Gel", "Body Splash",
        "Desodorante Corporal", "Cuidados Corporais", "Hidratação Corporal", "Limpeza",
        "Tratamento", "Cuidado Pessoal",
    ],
    "Cabelos": [
        "Cabelo", "Hair", "Shampoo", "Condicionador", "Máscara Capilar", "Leave-in", "Finalizador",
        "Óleo Capilar", "Tratamento Capilar", "Cuidado Capilar", "Coloração", "Tintura",
    ],
    "Skincare": [
        "Cuidados Faciais", "Facial", "Rosto", "Anti-idade", "Anti-rugas", "Sérum", "Vitamina C",
        "Ácido Hialurônico", "Retinol", "Cleanser", "Tônico", "Hidratante Facial",
        "Protetor Facial", "Creme Facial", "Máscara Facial", "Esfoliante Facial",
        "Limpeza Facial", "Demaquilante", "Água Micelar",
    ],
    "Infantil": ["Bebê", "Baby", "Criança", "Kids", "Infantil", "Linha Bebê"],
    "Masculino": ["Homem", "Men", "Masculina", "Barba", "Pós-barba", "Barbear"],
    "Unhas": ["Esmalte", "Nail", "Unha", "Cutículas", "Base para Unhas", "Top Coat"],
    "Acessórios": [
        "Acessório", "Necessaire", "Bolsa", "Espelho", "Pincel", "Aplicador", "Esponja",
    ],
    "Kits e Presentes": [
        "Kit", "Combo", "Presente", "Gift", "Conjunto", "Coleção", "Edição Especial",
    ],
    "Proteção Solar": [
        "Protetor Solar", "FPS", "Sunscreen", "Bronzeador", "Pós-Sol", "Solar",
    ],
    "Desodorantes": [
        "Desodorante", "Antitranspirante", "Deo", "Roll-on", "Aerossol", "Spray",
    ],
}

# Label of a category nothing matches; label used in saved statistics; threshold.
UNMAPPED = "Outros"
UNMAPPED_IN_STATISTICS = "Other"
FUZZY_THRESHOLD = 75

# Ordered (pattern, brand) lists for file names, and the defaults.
BRAND_PATTERNS = [
    ("boticario", "O Boticário"), ("boticário", "O Boticário"), ("natura", "Natura"),
    ("avon", "Avon"), ("eudora", "Eudora"), ("quem disse", "Quem Disse, Berenice?"),
]
BRAND_DEFAULT = "Unknown"
BRAND_KEYS = [("boticario", "boticario"), ("natura", "natura"), ("botica", "boticario")]
BRAND_KEY_DEFAULT = "natura"

# Promotion types, page types without products.
PROMO_TYPES = ["none", "simple_discount", "progressive_discount", "combo", "buy_x_pay_y", "pack"]
PAGES_WITHOUT_PRODUCTS = ["publicidade", "indice"]
DEFAULT_PAGE_TYPE = "produtos"

# Right-closed bins and their labels.
PRICE_TIERS = [(30, "Budget"), (60, "Economy"), (100, "Standard"), (200, "Premium")]
PRICE_TIER_TOP = "Luxury"
DISCOUNT_EDGES = [0, 10, 20, 30, 40, 50, 100]
DISCOUNT_LABELS = ["No Discount", "1-10%", "11-20%", "21-30%", "31-40%", "41-50%", "50%+"]
CLUSTER_NAMES = [(50, "Budget"), (100, "Economy"), (200, "Premium")]
CLUSTER_TOP = "Luxury"

# Texts that stand for a missing value.
NULL_CODES = ["None", "none", ""]
NULL_TEXTS = ["", "None", "none", "null", "NULL"]
PLACEHOLDER = "-"

# Stop-words and keyword families of product names (first family wins).
STOP_WORDS = [
    "de", "da", "do", "das", "dos", "para", "com", "em", "e", "o", "a", "os", "as", "um", "uma",
    "ml", "g", "gr", "x", "kit", "set",
]
SCENT_FAMILIES = [
    ("floral", ["rosa", "flor", "jasmin", "orquídea", "gardênia", "violeta", "lírio"]),
    ("frutal", ["frutas", "morango", "cereja", "maçã", "pêssego", "framboesa", "amora", "uva"]),
    ("amadeirado", ["madeira", "sândalo", "cedro", "canela", "âmbar"]),
    ("cítrico", ["limão", "laranja", "bergamota", "tangerina", "citrus"]),
    ("gourmand", ["chocolate", "baunilha", "caramelo", "café", "mel", "doce"]),
    ("fresco", ["menta", "água", "marine", "fresh", "acqua"]),
]
SCENT_DEFAULT = "other"

# Names of document fields and of analysis columns.
DOCUMENT_TO_ANALYSIS = {
    "code": "codigo", "name": "nome", "product_line": "linha", "category": "categoria",
    "normalized_category": "categoria_normalizada", "volume_weight": "volume_peso",
    "quantity": "quantidade", "regular_price": "preco_regular",
    "promotional_price": "preco_promocional", "savings": "economia",
    "discount_percentage": "desconto_percentual", "promotion_active": "promocao_ativa",
    "promotional_rule": "regra_promocional", "features": "caracteristicas", "page": "pagina",
    "quadrant": "quadrante", "alerts": "alertas",
}
EXPORT_COLUMNS = [
    "codigo", "nome", "linha", "categoria_normalizada", "volume_peso", "preco_regular",
    "preco_promocional", "economia", "desconto_percentual", "promocao_ativa", "promo_type",
    "brand", "cycle", "pagina",
]
TEXT_COLUMNS = ["nome", "linha", "categoria", "categoria_normalizada", "volume_peso", "quadrante"]
NUMERIC_COLUMNS = [
    "preco_regular", "preco_promocional", "economia", "desconto_percentual", "pagina",
]
DISPLAY_TEXT_COLUMNS = [
    "codigo", "nome", "linha", "categoria", "categoria_normalizada", "volume_peso", "quantidade",
    "quadrante", "promo_type", "promo_description",
]
KEY_FIELDS = [
    "codigo", "nome", "linha", "categoria_normalizada", "volume_peso", "preco_regular",
    "preco_promocional", "desconto_percentual", "economia",
]

# Validation limits.
MIN_CODE_LENGTH = 4
MAX_CODE_LENGTH = 6
MAX_PRICE = 10000.0
MAX_DISCOUNT_PCT = 80
SAVINGS_TOLERANCE = 0.10
MIN_NAME_LENGTH = 3

# Characters a name may hold besides letters, digits, underscore and blanks.
NAME_EXTRA_CHARACTERS = r"°º%/\-+()"
# Volume texts that count as recognised.
VOLUME_PATTERN = r"\d+\s*ml|\d+\s*g|\d+\s*kg|\d+\s*l|\d+\s*unidades?|\d+\s*un|\d+\s*x\s*\d+"

# Alert texts.
ALERT_TEXTS = {
    "code_missing": "Product code is missing",
    "code_non_numeric": "Product code contains non-numeric characters: %s",
    "code_short": "Product code seems too short: %s",
    "code_long": "Product code seems too long: %s",
    "name_short": "Product name is missing or too short",
    "name_unusual": "Product name contains unusual characters",
    "price_zero": "Regular price is zero or negative",
    "price_high": "Regular price seems unusually high: R$ %s",
    "promo_zero": "Promotional price is zero or negative",
    "promo_above": "Promotional price (R$ %s) is higher than regular price (R$ %s)",
    "promo_equal": "Promotional price equals regular price (no discount)",
    "discount_high": "Discount seems unusually high: %s%%",
    "savings_differ": "Savings value doesn't match price difference. Expected: R$ %s, Got: R$ %s",
    "category_unmapped": "Category could not be normalized: %s",
    "volume_unknown": "Volume/weight format not recognized: %s",
    "flag_missing": "Product has promotional price but promocao_ativa is False",
    "tiers_missing": "Progressive discount rule has no discount tiers defined",
    "combo_missing": "Combo rule has no combo codes defined",
    "code_duplicate": "Duplicate product code found: %s",
    "prices_swapped": "Prices were swapped (promotional was higher than regular)",
}
