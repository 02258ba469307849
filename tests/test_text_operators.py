"""Sizes, names, brands, aisles, presentations and text helpers on named examples."""

from pyspark.sql import functions as F

from larder.functions.text import fold, html_to_text, tidy_name
from larder.operators import classify as cl
from larder.operators import measure as ms

SIZES = {
    "LENTEJA 3.500 G": (3500, "g"), "Sardina (95.5 gr)": (95.5, "g"), "Kumis 2,2 L": (2.2, "l"), "Fideos (750  gr)": (750, "g"),
    "Frijol Montaña x 450g": (450, "g"), "Cocoa (sin azúcar) (250 gr)": (250, "g"), "Pavo 3.400 Kg": (3.4, "kg"),
    "Jabón 2 en 1 400 ml": (400, "ml"), "Jugo Pera 3L 15G": (15, "g"), "Barra Kit Kat 45 g": (45, "g"), "Avena Sol+ 2 Kg": (2, "kg"),
    "Panela 1850 125g": (125, "g"), "4 x 250 ml": None, "Té 3 200 g": None, "Camarón 21-25 Kg": None, "Ponqué 2,000 g": None,
    "Simparica 20Kg": None, "Lenteja 3/4 kg": None, "Perro 10Kg 25Kg": None, "Kumis 1,25 G": None, "Combo 300 G + Jamón 300 G": None,
    "Malta six pack (330 ml)": None, "Perros hasta 7.5Kg": None, "Crema 31, 5G": None, "Perros de 2 a 6 Kg": None, "Vacío": None,
    "Pilas #   9 300 g": (300, "g"), "Gel 5     en    1 300 ml": (300, "ml"), "Bolsa             7 300 g": None,
}


def test_sizes(spark):
    df = spark.createDataFrame([(n,) for n in SIZES], "name string")
    got = {r.name: (float(r.unit_value), r.unit_measure) if r.unit_measure else None for r in ms.extract_measures(df).collect()}
    assert got == SIZES


def test_erp_sizes(spark):
    cases = {
        ("BIZCOCHO MERIENDA 190G TENTACION", "viveres"): (190, "g", "190G"), ("LECHE PRADERA 1000C", "lacteos"): (1000, "ml", "1000C"),
        ("HUEVOS AA 15U", "lacteos"): (15, "un", "15U"), ("AZUCAR X 3.500 G", "viveres"): (3500, "g", "3.500 G"),
        ("VINO VALLE 700M", "otros"): (700, "ml", "700M"), ("PAPEL MANTEQUILLA LUX 9M", "aseo-hogar"): None,
        ("SARDINA MAR 3 120G", "viveres"): None, ("BARRA TRIGO 5U 120G", "viveres"): None, ("JABON AZUL X3 270G", "aseo-hogar"): None,
        ("CREMA AHUYAMA 61, 5G", "viveres"): None, ("NECTAR SOL 1000L", "bebidas"): None,
    }
    df = spark.createDataFrame(list(cases), "title string, aisle string")
    got = {
        (r.title, r.aisle): (float(r.unit_value), r.unit_measure, r.size_token) if r.unit_measure else None
        for r in ms.extract_measures_erp(df).collect()
    }
    assert got == cases


def test_names_and_brands(spark):
    cases = [
        ("Fideos CASERA cabello fino (750  gr)", "CASERA", "Fideos cabello fino"), ("Fécula 80 G", "Fécula", "Fécula 80 G"),
        ("MENTAX TUBO SURTIDO", "MENTAX", "MENTAX TUBO SURTIDO"), ("Jugo V8+ frío", "V8+", "Jugo frío"), ("Tubo DENTIL", "dentil", "Tubo DENTIL"),
        ("Kumis LA CABRA suave", "la cabra", "Kumis suave"), ("café x", None, "Café x"), ("(500 g)", "X", "(500 g)"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "name string, brand string")
    assert [r.clean_name for r in ms.clean_names(df).collect()] == [c[2] for c in cases]
    brands = ["sin marca", "Sin Marca 2", "GENÉRICO", "n/a", "-", "20.09", "1800", "LA  CABRITA", "", None]
    df = spark.createDataFrame([(b,) for b in brands], "brand string")
    assert [r.clean_brand for r in ms.clean_brands(df).collect()] == [None] * 6 + ["1800", "La Cabrita", None, None]


def test_aisles_by_layer(spark):
    cases = [
        ("Galleta de arroz", None, "galletas"), ("Papa criolla", "frutas-verduras", "verduras"), ("Papas limón", "otros", "snacks"), ("Papa", None, "verduras"),
        ("Tomate manzana", "frutas-verduras", "verduras"), ("Manzana tomate", "frutas-verduras", "frutas"), ("Helado de mango", "otros", "congelados"),
        ("Muslo de pollo", "viveres", "pollo"), ("Ravioli relleno de pollo", "viveres", "otros"), ("Cosas varias", "otros", "otros"), ("hueso de cerdo", "mascotas", "mascotas"),
        ("Piña", None, "frutas"), ("Zanahoria", None, "verduras"), ("Qwerty", "lacteos", "leche"), ("Jugo de mango", None, "jugos"),
        ("Ambientador vainilla", "congelados", "aseo-hogar"), ("Arepas de choclo", "congelados", "arepas"), ("Croqueta de pescado", "congelados", "congelados"),
        ("Gelatina de pera", None, "dulces"), ("Shampoo de avena", None, "cuidado-personal"), ("Arena sanitaria", "aseo-hogar", "mascotas"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "name string, source_bucket string")
    assert [r.category_slug for r in cl.classify(df).collect()] == [c[2] for c in cases]


def test_presentations(spark):
    rows = [("Huevos", "unit", 30, "un"), ("Huevos", "unit", 12, "un"), ("Huevos", "unit", 6, "un"), ("Huevos", "unit", 15, "un"),
            ("Leche", "volume", 1100, "ml"), ("Arroz", "weight", 500, "g"), ("Jabón", "unit", 3, "un"), ("Cosa", "unit", None, None)]
    df = spark.createDataFrame(rows, "name string, unit_kind string, unit_value int, unit_measure string").withColumn(
        "unit_value", F.col("unit_value").cast("decimal(10,3)"))
    assert [r.presentation for r in cl.describe_presentations(df).collect()] == [
        "Cartón x 30", "Docena", "Media docena", "Panal x 15", "Bolsa 1,1 L", "Paquete 500 g", "Paquete x 3", "Unidad"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("<b>Calle 5</b> &#8211; &quot;X&quot; &amp;lt; &#xE9; &nbsp;&foo; “a”", "  BOGOTÁ d.c (norte)/sur-este 3abc")], "h string, t string")
    row = df.select(html_to_text(F.col("h")).alias("h"), tidy_name(F.col("t")).alias("t"), fold(F.lit("PIÑA Crème")).alias("f")).first()
    assert (row.h, row.t, row.f) == ("Calle 5 – X &lt; é &foo; a", "Bogotá D.c (Norte)/Sur-Este 3abc", "pina creme")
