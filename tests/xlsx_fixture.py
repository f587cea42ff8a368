"""Build small .xlsx files from parts (no spreadsheet library needed)."""

import zipfile
from xml.sax.saxutils import escape


def _col(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def write_xlsx(path, sheets):
    """sheets: list of (name, hidden, rows); a cell is None, str, number,
    ("date", serial) or ("formula", text) with no cached value."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                   '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        sheet_xml, rels = [], []
        for i, (name, hidden, rows) in enumerate(sheets, start=1):
            state = ' state="hidden"' if hidden else ""
            sheet_xml.append(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"{state}/>')
            rels.append(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml" '
                        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/>')
            body = []
            for r, row in enumerate(rows, start=1):
                cells = []
                for c, v in enumerate(row, start=1):
                    ref = f"{_col(c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, tuple) and v[0] == "date":
                        cells.append(f'<c r="{ref}" s="1"><v>{v[1]}</v></c>')
                    elif isinstance(v, tuple) and v[0] == "formula":
                        cells.append(f'<c r="{ref}"><f>{escape(v[1])}</f></c>')
                    elif isinstance(v, str):
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
                    else:
                        cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                body.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml",
                       '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                       f'<sheetData>{"".join(body)}</sheetData></worksheet>')
        z.writestr("xl/workbook.xml",
                   '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                   'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   f'<sheets>{"".join(sheet_xml)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   f'{"".join(rels)}</Relationships>')
