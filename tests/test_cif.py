"""CIF tables and assemblies, on hand-made files."""

import pytest
from pyspark.sql import functions as F

from quarry.sources import cif, structures

TEXT = """# a comment
data_one
_entry.id 'ONE''S'
_struct.title
;A title; with
 two lines
;
loop_
_pdbx_struct_assembly_gen.assembly_id
_pdbx_struct_assembly_gen.oper_expression
_pdbx_struct_assembly_gen.asym_id_list
1 '(P)(1-2)' A,B
1 1 C
2 1,3 A
loop_
_pdbx_struct_oper_list.id
""" + "\n".join(f"_pdbx_struct_oper_list.matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)) + """
_pdbx_struct_oper_list.vector[1]
_pdbx_struct_oper_list.vector[2]
_pdbx_struct_oper_list.vector[3]
1 1 0 0 0 1 0 0 0 1 0 0 0
2 -1 0 0 0 -1 0
  0 0 1 10 0 0
3 1 0 0 0 1 0 0 0 1 5 5 5
P 0 1 0 1 0 0 0 0 -1 0 0 1
#
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_asym_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.pdbx_PDB_model_num
ATOM C CA A 1 2 3 1
ATOM C
"C1'" B
4 5 6
1
HETATM O 'O"5' C 0 0 0 1
data_two
_entry.id TWO
_pdbx_struct_assembly_gen.assembly_id 1
_pdbx_struct_assembly_gen.oper_expression ?
_pdbx_struct_assembly_gen.asym_id_list "A"
"""


def test_tokens_and_rows():
    assert [t for _, t in cif.tokens("a 'b c' \"d'e\" 'it's' #no\n;x\ny\n; z")] == ["a", "b c", "d'e", "it's", "x\ny", "z"]
    assert list(cif.rows_of(TEXT, "struct", ["title", "none"])) == [["A title; with\n two lines", None]]
    assert list(cif.rows_of("loop_ _a.x _a.y 1 '?' ? . _b.z 3", "a", ["y", "x"])) == [["?", "1"], [None, None]]
    for bad in ("loop_ _a.x _a.y 1 2 3", "loop_ _a.x _a.y 1 2 3 _b.c 4"):
        with pytest.raises(ValueError, match="1 of 2"):
            list(cif.rows_of(bad, "a", ["x"]))


def test_expressions():
    assert cif.operations("1,2") == [["1"], ["2"]] and cif.operations("(1-3)") == [["1"], ["2"], ["3"]]
    assert cif.operations("(1-3)(4,5)") == [["4", "1"], ["5", "1"], ["4", "2"], ["5", "2"], ["4", "3"], ["5", "3"]]
    assert cif.operations("(X0)(1-60)")[59] == ["60", "X0"] and cif.operations("P,1-2") == [["P"], ["1"], ["2"]] and cif.operations("") == []


def test_blocks_and_assemblies(spark, tmp_path):
    (tmp_path / "x.cif").write_text(TEXT)
    entries = cif.read_category(spark, str(tmp_path), "entry", ["id"]).collect()
    assert {(r.data_block, r.id) for r in entries} == {("one", "ONE''S"), ("two", "TWO")}
    atoms = structures.read_mmcif_atoms(spark, str(tmp_path))
    assert [(r.atom_name, r.chain_id, r.x, r.hetero) for r in atoms.orderBy("atom_idx").collect()] == [("CA", "A", 1.0, False), ("C1'", "B", 4.0, False), ('O"5', "C", 0.0, True)]
    listed = cif.read_assemblies(spark, str(tmp_path)).where("data_block = 'one'")
    assert sorted((r.assembly_id, r.sym_id, r.chain_id) for r in listed.collect()) == [("1", 0, "A"), ("1", 0, "B"), ("1", 1, "A"), ("1", 1, "B"), ("1", 2, "C"), ("2", 0, "A"), ("2", 1, "A")]
    # the rightmost group first: 1 or 2, then P
    got = sorted((r.chain_id, r.sym_id, r.x, r.y, r.z) for r in cif.expanded(atoms, listed).collect())
    assert got == [("A", 0, 2.0, 1.0, -2.0), ("A", 1, -2.0, 9.0, -2.0), ("B", 0, 5.0, 4.0, -5.0), ("B", 1, -5.0, 6.0, -5.0), ("C", 2, 0.0, 0.0, 0.0)]
    assert {(r.sym_id, r.x) for r in cif.expanded(atoms, listed, "2").collect()} == {(0, 1.0), (1, 6.0)}
    assert cif.expanded(atoms, listed, "9").select("sym_id").distinct().count() == 1 and cif.expanded(atoms, listed, "9").count() == 3
    counts = cif.polymer_counts(listed, atoms.where(~F.col("hetero")))
    assert {(r.assembly_id, r.n) for r in counts.collect()} == {("1", 4), ("2", 2)}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "y.cif").write_text(TEXT.replace("'(P)(1-2)'", "9"))
    with pytest.raises(Exception, match="not listed"):
        cif.read_assemblies(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "z.cif").write_text(TEXT.replace("4 5 6\n1\n", "4 5 6\n"))
    with pytest.raises(Exception, match="of 8 values"):
        structures.read_mmcif_atoms(spark, str(tmp_path / "short")).collect()
