"""The published column blocks: sums of text numbers, joined values, parts of long lists."""

from decimal import Decimal

from contrapunto import schemas as S
from contrapunto.operators import blocks as B


def contracts(spark, rows):
    fields = list(dict.fromkeys([f for _, f, _ in S.CONTRACT_BLOCK] + ["tipodocproveedor", "objeto_del_contrato", "orden", "saldo"]))
    data = [(p, k, *[{"id_contrato": f"C{k:03}", **r}.get(f) for f in fields]) for k, (p, r) in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(["process_id string", "seq long", *[f"`{f}` string" for f in fields]]))


def test_contract_block(spark):
    rows = [("P1", {"referencia_del_contrato": "R", "estado_contrato": "b", "valor_del_contrato": "1,000.50", "dias_adicionados": "3", "rama": " x ", "fecha_de_firma": "2024-05-01T00:00:00", "documento_proveedor": "9", "tipodocproveedor": "NIT",
                    "orden": "Nacional|uno", "saldo": "0", "objeto_del_contrato": "no sale"}),
            ("P1", {"referencia_del_contrato": "R", "estado_contrato": "a", "valor_del_contrato": "nada", "dias_adicionados": "4", "rama": "No definido", "fecha_de_firma": "2024-05-01", "documento_proveedor": "8", "saldo": "5"}),
            ("P1", {"estado_contrato": "b", "rama": "w", "valor_del_contrato": "2", "fecha_de_firma": ""}), ("P2", {})]
    got = {r["process_id"]: r for r in B.contract_block(contracts(spark, rows)).collect()}
    one, two = got["P1"], got["P2"]
    assert len(one) == 2 + 24 and [len(S.CONTRACT_BLOCK), len(S.PROCESS_BLOCK)] == [23, 25]
    want = {"Contrato: ID(s)": "C000 | C001 | C002", "Contrato: Referencia": "R | R", "Contrato: Estado": "a | b", "Contrato: NIT/doc proveedor": "8 | NIT:9", "Contrato: Valor": Decimal("1002.5"), "Contrato: Días adicionados": 7,
            "Contrato: Valor pagado": None, "Contrato: Rama": "x | w", "Contrato: Fecha firma": "2024-05-01", "Contrato: Otros campos": "orden=Nacional uno | saldo=5", "part": 0}
    assert {k: one[k] for k in want} == want
    assert two["Contrato: ID(s)"] == "C003" and all(two[label] is None for label, f, _ in S.CONTRACT_BLOCK if f != "id_contrato")
    many = B.contract_block(contracts(spark, [("P", {"valor_del_contrato": "1", "estado_contrato": "s"})] * 40), cell=16).orderBy("part").collect()
    assert [len(r["Contrato: ID(s)"].split(" | ")) for r in many] == [16, 16, 8] and [r["Contrato: Valor"] for r in many] == [40, None, None] and [r["Contrato: Estado"] for r in many] == ["s", None, None]
    assert B.contract_block(contracts(spark, [])).count() == 0


def test_process_mirror(spark):
    fields = [f for _, f, _ in S.PROCESS_BLOCK] + ["unidad_de_duracion", "entidad", "categoria", "vacia"]
    row = {"precio_base": "1,204,000.00", "valor_total_adjudicacion": "12.50", "numero_de_lotes": "100", "proveedores_invitados": "N/A", "respuestas_al_procedimiento": "0", "duracion": "60", "unidad_de_duracion": "día(s)",
           "fecha_de_publicacion_del": "2024-01-31T08:00", "nombre_del_procedimiento": "", "entidad": "E", "categoria": "a|b", "vacia": "No Definido"}
    d = spark.createDataFrame([("P", *[row.get(f) for f in fields])], ", ".join(["process_id string", *[f"`{f}` string" for f in fields]]))
    r = B.process_mirror(d).first()
    assert len(r) == 1 + 26
    want = {"Proceso: Precio base": "1204000", "Proceso: Valor adjudicación": "12.5", "Proceso: # lotes": "100", "Proceso: # proveedores invitados": "N/A", "Proceso: # ofertas recibidas": "0", "Proceso: Duración": "60 día(s)",
            "Proceso: Fecha publicación": "2024-01-31", "Proceso: Nombre": None, "Proceso: Otros campos": "categoria=a b"}
    assert {k: r[k] for k in want} == want
