"""Fixed values and landed-table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- Fixed values (must equal the published data's own spellings) -----------

PLACEHOLDERS = [
    "", "no definido", "no definida", "no aplica", "n/a",
    "sin descripcion", "sin descripción",
]
LIST_PLACEHOLDERS = ["", "No definido", "No Definido", "No Definida"]

CONFIDENCE_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}

TRACKING_KEYS = ["ismodal", "isfrompublicarea", "currentlanguage", "skinname", "country", "page"]
ID_QUERY_KEYS = ["noticeuid", "noticeid", "ppi", "processid", "pccntr"]
ID_PATTERN = r"CO1\.([A-Z]+)\.[0-9A-Za-z]+"
GENESIS = "0" * 64

MONTHS_ES = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10,
    "noviembre": 11, "diciembre": 12,
}
NUMBER_WORDS_ES = {
    "un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5,
    "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12,
}
# (unit pattern start, days)
UNIT_DAYS = {"d": 1, "s": 7, "m": 30, "a": 365}

# Weights of the tax-id check digit, lowest digit first, and its result table.
CHECK_WEIGHTS = [3, 7, 13, 17, 19, 23, 29, 37, 41, 43, 47, 53, 59, 67, 71]
CHECK_RESULTS = "01987654321"

CORE_TYPES = [
    "Modificatorio", "Adicion", "Prorroga", "Otrosi", "Adenda", "Cesion",
    "Suspension", "Reanudacion", "Terminacion anticipada", "Liquidacion", "Novacion",
]
SUPPORT_TYPES = ["Aclaratorio", "Legalizacion (soporte)", "Compromiso (soporte)", "Poliza (soporte)"]
GENERIC_TYPES = ["Modificatorio", "Otrosi", "Adenda"]
TYPE_ORDER = [
    "Adicion", "Prorroga", "Modificatorio", "Otrosi", "Adenda", "Cesion",
    "Suspension", "Reanudacion", "Terminacion anticipada", "Novacion", "Liquidacion",
]
TYPE_LABELS = {
    "Modificatorio": ("Modificatorio", "Modificatorios"),
    "Otrosi": ("Otrosi", "Otrosies"),
    "Adenda": ("Adenda", "Adendas"),
    "Adicion": ("Adicion", "Adiciones"),
    "Prorroga": ("Prorroga", "Prorrogas"),
    "Cesion": ("Cesion", "Cesiones"),
    "Suspension": ("Suspension", "Suspensiones"),
    "Liquidacion": ("Liquidacion", "Liquidaciones"),
    "Terminacion anticipada": ("Terminacion", "Terminaciones"),
    "Reanudacion": ("Reanudacion", "Reanudaciones"),
    "Novacion": ("Novacion", "Novaciones"),
}

# Ledger columns the sources can fill (key used in code, published header).
LEDGER_COLUMNS = {
    "numero": "2. NÚMERO DE CONTRATO",
    "vigencia": "3.VIGENCIA",
    "objeto": "4. OBJETO",
    "fecha_suscripcion": "5. FECHA SUSCRIPCIÓN",
    "plazo": "6. PLAZO",
    "fecha_inicio": "8. FECHA INICIO",
    "fecha_terminacion": "9. FECHA TERMINACIÓN",
    "estado": "10.ESTADO DEL CONTRATO",
    "lugar": "11.LUGAR DE EJECUCIÓN",
    "modalidad": "12. MODALIDAD DE SELECCIÓN",
    "clase": "13. CLASE DE CONTRATO",
    "tipo_orden": "16. TIPO DE ORDEN",
    "entidad_nit": "20. ENTIDAD DE DONDE PROVIENEN LOS RECURSOS : NIT",
    "entidad_dv": "21. ENTIDAD DE DONDE PROVIENEN LOS RECURSOS : DÍGITO DE VERIFICACIÓN DEL NIT",
    "entidad_nombre": "22. ENTIDAD DE DONDE PROVIENEN LOS RECURSOS : NOMBRE",
    "fuente_recursos": "23. FUENTE DE RECURSOS",
    "valor_inicial": "28.VALOR INICIAL DEL CONTRATO (INCLUIDAS VIGENCIA ACTUAL Y FUTURAS)",
    "valor_inicial_vigencia": "29. VALOR INICIAL DEL CONTRATO VIGENCIA ACTUAL",
    "tipo_anticipos": "33. TIPO DE ANTICIPOS o PAGO ANTICIPADO",
    "valor_anticipos": "34. ANTICIPOS o PAGO ANTICIPADO : VALOR TOTAL",
    "tipo_adiciones": "35. TIPO DE ADICIONES",
    "reducciones": "35A. REDUCCIONES VALOR TOTAL",
    "adiciones": "35A. ADICIONES VALOR TOTAL",
    "valor_total": "36. VALOR TOTAL",
    "prorrogas_dias": "37. PRÓRROGAS : NÚMERO DE DÍAS",
    "naturaleza": "38. CONTRATISTA : NATURALEZA",
    "consorcio": "39. CONSORCIO O UNIÓN TEMPORAL",
    "tipo_id": "40. CONTRATISTA : TIPO IDENTIFICACIÓN",
    "num_id": "41. CONTRATISTA : NÚMERO DE IDENTIFICACIÓN CC, NIT O CEDULA DE EXTRANJERIA",
    "dv": "42. CONTRATISTA : DÍGITO DE VERIFICACIÓN NIT",
    "contratista": "43. CONTRATISTA : NOMBRE COMPLETO",
    "direccion": "44. DIRECCIÓN CONTRATISTA",
    "garantia_tipo": "47. GARANTÍAS : TIPO DE GARANTÍA",
    "garantia_riesgos": "48. GARANTÍAS : RIESGOS",
    "garantia_fecha": "49. GARANTÍAS : FECHA DE EXPEDICIÓN DE GARANTÍAS",
    "supervisor_id": "52. SUPERVISOR : NÚMERO DE IDENTIFICACIÓN CC, NIT O CEDULA",
    "supervisor": "53. SUPERVISOR : NOMBRE COMPLETO",
    "avance_fisico": "64. PORCENTAJE DE AVANCE FÍSICO REAL",
    "avance_presup": "66. PORCENTAJE AVANCE PRESUPUESTAL REAL",
    "requiere_liquidacion": "67.REQUIERE LIQUIDACIÓN?",
    "fecha_liquidacion": "68. FECHA LIQUIDACIÓN",
    "proceso": "70. NÚMERO DE PROCESO ASOCIADO AL CONTRATO",
    "link": "LINK",
    "ingreso": "VALOR TOTAL INGRESO",
}
# Columns only the entity itself may write, by their leading number or text.
INTERNAL_LABELS = [
    "7", "14", "15", "17", "18", "19", "24", "25", "25A", "26", "26A", "27", "30", "31",
    "32", "50", "51", "54", "55", "56", "57", "58", "59", "60", "61", "62", "63", "64",
    "65", "69", "72", "NOMBRE SUPERVISOR ACTUAL",
]
NUMERIC_KEYS = [
    "valor_inicial", "valor_inicial_vigencia", "valor_anticipos", "reducciones", "adiciones",
    "valor_total", "prorrogas_dias", "avance_fisico", "avance_presup", "ingreso",
]
DATE_KEYS = ["fecha_suscripcion", "fecha_inicio", "fecha_terminacion", "garantia_fecha", "fecha_liquidacion"]

# Header aliases of the 15 ledger fields, in the order they are tried.
HEADER_ALIASES = {
    "estado": ["10.ESTADO DEL CONTRATO", "ESTADO DEL CONTRATO"],
    "fecha_firma": ["5. FECHA SUSCRIPCION", "FECHA SUSCRIPCION"],
    "fecha_inicio": ["8. FECHA INICIO", "FECHA INICIO"],
    "fecha_terminacion": ["9. FECHA TERMINACION", "FECHA TERMINACION"],
    "valor_total": ["36. VALOR TOTAL", "36: VALOR TOTAL", "VALOR TOTAL"],
    "valor_inicial": ["28.VALOR INICIAL DEL CONTRATO", "VALOR INICIAL DEL CONTRATO"],
    "proveedor": ["43. CONTRATISTA : NOMBRE COMPLETO", "CONTRATISTA : NOMBRE COMPLETO", "NOMBRE COMPLETO"],
    "objeto": ["4. OBJETO", "OBJETO"],
    "modalidad": ["12. MODALIDAD DE SELECCION", "MODALIDAD DE SELECCION"],
    "dias_prorrogas": ["37. PRORROGAS : NUMERO DE DIAS", "PRORROGAS : NUMERO DE DIAS"],
    "adiciones_count": ["35A ADICIONES", "35. TIPO DE ADICIONES"],
    "liquidacion": ["67.REQUIERE LIQUIDACION", "REQUIERE LIQUIDACION"],
    "fecha_liquidacion": ["68. FECHA LIQUIDACION", "FECHA LIQUIDACION"],
    "numero_contrato": ["2. NUMERO DE CONTRATO", "NUMERO DE CONTRATO"],
    "supervisor": ["54.NOMBRE DEL INTERVENTOR", "NOMBRE DEL INTERVENTOR"],
}
LINK_HEADERS = ["LINK", "URL", "ENLACE"]

# Portal page labels (accents and colon removed) and the short key of each.
PORTAL_LABELS = {
    "Precio estimado total": "precio_estimado",
    "Numero del proceso": "numero_proceso",
    "Titulo": "titulo",
    "Fase": "fase",
    "Estado": "estado",
    "Descripcion": "descripcion",
    "Tipo de proceso": "tipo_proceso",
    "Limitacion de todo el proceso a MiPymes": "mipyme_limitacion",
    "Tipo de contrato": "tipo_contrato",
    "Justificacion de la modalidad de contratacion": "justificacion_modalidad",
    "Duracion del contrato": "duracion_contrato",
    "Direccion de ejecucion del contrato": "direccion_ejecucion",
    "Codigo UNSPSC": "unspsc_principal",
    "Lista adicional de codigos UNSPSC": "unspsc_adicional",
    "Lotes?": "lotes",
    "Dar publicidad al proceso": "dar_publicidad",
    "Uso del modulo de forma publicitaria?": "modulo_publicitario",
    "Fecha de Firma del Contrato": "fecha_firma_contrato",
    "Fecha de inicio de ejecucion del contrato": "fecha_inicio_ejecucion",
    "Plazo de ejecucion del contrato": "plazo_ejecucion",
    "Fecha de terminacion del contrato": "fecha_terminacion",
    "Fecha de publicacion": "fecha_publicacion",
    "Destinacion del gasto": "destinacion_gasto",
    "Valor total": "valor_total",
    "Solicitud de garantias?": "solicita_garantias",
    "% del valor del contrato": "garantia_pct_valor",
    "Fecha de vigencia (desde)": "garantia_vigencia_desde",
    "Fecha de vigencia (hasta)": "garantia_vigencia_hasta",
    "Responsabilidad civil extra contractual": "garantia_resp_civil",
    "Cumplimiento": "garantia_cumplimiento",
    "No. de SMMLV": "garantia_smmlv",
}
CRITICAL_FIELDS = ["titulo", "tipo_proceso", "numero_proceso"]

# ---- Landed-table schemas ---------------------------------------------------

PORTAL_ENTRY = T.StructType([
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("all_labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("documents", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("url", T.StringType())]))),
    T.StructField("notificaciones", T.ArrayType(T.StructType([
        T.StructField("proceso", T.StringType()), T.StructField("evento", T.StringType()),
        T.StructField("fecha", T.StringType())]))),
    T.StructField("status", T.StringType()),
    T.StructField("missing_fields", T.ArrayType(T.StringType())),
    T.StructField("scraped_at", T.StringType()),
])

AUDIT_LOG = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("op", T.StringType()),
    T.StructField("process_id", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("old", T.StringType()),
    T.StructField("new", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("payload_hash", T.StringType()),
    T.StructField("code_version", T.StringType()),
    T.StructField("prev_hash", T.StringType()),
    T.StructField("hash", T.StringType()),
])

MONEY = T.DecimalType(18, 2)
TOTAL = T.DecimalType(38, 2)

# ---- Published column blocks (fixed values) ---------------------------------

# Contract block, a row per process: (published label, source field, how contracts are put together).
CONTRACT_BLOCK = [
    ("Contrato: ID(s)", "id_contrato", "lista"),
    ("Contrato: Referencia", "referencia_del_contrato", "lista"),
    ("Contrato: Estado", "estado_contrato", "conjunto"),
    ("Contrato: Proveedor adjudicado", "proveedor_adjudicado", "conjunto"),
    ("Contrato: NIT/doc proveedor", "documento_proveedor", "documento"),
    ("Contrato: Valor", "valor_del_contrato", "suma"),
    ("Contrato: Valor pagado", "valor_pagado", "suma"),
    ("Contrato: Valor facturado", "valor_facturado", "suma"),
    ("Contrato: Valor pendiente pago", "valor_pendiente_de_pago", "suma"),
    ("Contrato: Duración", "duraci_n_del_contrato", "valores"),
    ("Contrato: Días adicionados", "dias_adicionados", "suma"),
    ("Contrato: Fecha firma", "fecha_de_firma", "fechas"),
    ("Contrato: Fecha inicio", "fecha_de_inicio_del_contrato", "fechas"),
    ("Contrato: Fecha fin", "fecha_de_fin_del_contrato", "fechas"),
    ("Contrato: ¿Liquidación?", "liquidaci_n", "valores"),
    ("Contrato: Fecha inicio liquidación", "fecha_inicio_liquidacion", "fechas"),
    ("Contrato: Fecha fin liquidación", "fecha_fin_liquidacion", "fechas"),
    ("Contrato: Supervisor", "nombre_supervisor", "valores"),
    ("Contrato: Ordenador del gasto", "nombre_ordenador_del_gasto", "valores"),
    ("Contrato: Origen recursos", "origen_de_los_recursos", "valores"),
    ("Contrato: ¿Prorrogable?", "el_contrato_puede_ser_prorrogado", "valores"),
    ("Contrato: Rama", "rama", "valores"),
    ("Contrato: Sector", "sector", "valores"),
]
CONTRACT_EXTRAS = "Contrato: Otros campos"
# Fields that are shown elsewhere and stay out of the catch-all, besides those above.
CONTRACT_SHOWN = ["tipodocproveedor", "valor_pendiente_de_ejecucion", "nombre_entidad", "nit_entidad", "objeto_del_contrato", "descripcion_del_proceso",
                  "modalidad_de_contratacion", "proceso_de_compra", "urlproceso", "tipo_de_contrato", "codigo_entidad", "codigo_proveedor"]

# Process block, a row per process: (published label, source field, how the value is cleaned).
PROCESS_BLOCK = [
    ("Proceso: Modalidad", "modalidad_de_contratacion", "texto"),
    ("Proceso: Justificación modalidad", "justificaci_n_modalidad_de", "texto"),
    ("Proceso: Tipo contrato", "tipo_de_contrato", "texto"),
    ("Proceso: Subtipo contrato", "subtipo_de_contrato", "texto"),
    ("Proceso: Referencia", "referencia_del_proceso", "texto"),
    ("Proceso: Nombre", "nombre_del_procedimiento", "texto"),
    ("Proceso: Adjudicador", "nombre_del_adjudicador", "texto"),
    ("Proceso: Unidad de contratación", "nombre_de_la_unidad_de", "texto"),
    ("Proceso: Departamento entidad", "departamento_entidad", "texto"),
    ("Proceso: Ciudad entidad", "ciudad_entidad", "texto"),
    ("Proceso: Precio base", "precio_base", "numero"),
    ("Proceso: Valor adjudicación", "valor_total_adjudicacion", "numero"),
    ("Proceso: NIT proveedor adjudicado", "nit_del_proveedor_adjudicado", "texto"),
    ("Proceso: Nombre proveedor adjudicado", "nombre_del_proveedor", "texto"),
    ("Proceso: Duración", "duracion", "duracion"),
    ("Proceso: # lotes", "numero_de_lotes", "numero"),
    ("Proceso: # ofertas recibidas", "respuestas_al_procedimiento", "numero"),
    ("Proceso: # proveedores invitados", "proveedores_invitados", "numero"),
    ("Proceso: # proveedores manifestaron", "proveedores_que_manifestaron", "numero"),
    ("Proceso: Fecha publicación", "fecha_de_publicacion_del", "fecha"),
    ("Proceso: Fecha fase 3", "fecha_de_publicacion_fase_3", "fecha"),
    ("Proceso: Fecha apertura ofertas", "fecha_de_apertura_efectiva", "fecha"),
    ("Proceso: Última publicación", "fecha_de_ultima_publicaci", "fecha"),
    ("Proceso: ID adjudicación", "id_adjudicacion", "texto"),
    ("Proceso: Estado", "estado_del_procedimiento", "texto"),
]
PROCESS_EXTRAS = "Proceso: Otros campos"
PROCESS_SHOWN = ["unidad_de_duracion", "id_del_proceso", "id_del_portafolio", "urlproceso", "fase", "entidad", "nit_entidad", "descripci_n_del_procedimiento",
                 "nombre_entidad", "ordenentidad", "codigo_entidad", "codigo_pci", "ppi", "id_estado_del_procedimiento"]
