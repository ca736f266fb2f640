"""Inspected examples: passages written after those seen in the smallest tables, by kind.

They start the mixture's components (one per key) and name them after fitting. The part of a
key before the colon is the class that its component stands for.
"""

EXAMPLES: dict[str, list[str]] = {
    "prose:plain": [
        "The warning about the parser is correct and should stay. We still do not know who owns core/reader.py, and the old map counts 12 callers for it.",
        "A reader who only knows the summary cannot tell which branch is meant, although the note was rewritten last week and lost two paragraphs on the way.",
        "It is easier to widen the check than to defend a missing one. I would rather keep the list short than guess what the reviewer meant.",
    ],
    "prose:wrapped": [
        "We reran the suite after the change was moved and the\nanswer stayed the same. This note replaces what was\nwritten on Friday about the cache. Please do not merge\nthis before the log has been read again.",
        "> You can see in the table that the handler was never\n> reached. Both branches keep their own copy and neither\n> is stale, but the index was never refreshed.",
    ],
    "prose:german": [
        "Die Tabelle wurde letzte Woche neu gebaut und verlor dabei zwölf Zeilen. Ohne eine Probe wird niemand gewarnt, aber der Bereitschaftsdienst möchte wissen, ob das Modul überhaupt geprüft wird.",
        "Wenn die Liste nicht stimmt, darf das Werkzeug nicht antworten. Ich habe 20 Minuten gebraucht, um den Fehler zu finden.",
    ],
    "prose:romance": [
        "Le rapport a été refait lundi matin et il a perdu neuf lignes. Sans contrôle pour ce parcours, personne n'est prévenu, mais la relectrice a vu que la fonction ne touche plus le fichier.",
        "El informe se rehizo en primavera y perdió tres filas por el camino. Una colega nueva pregunta si el módulo se revisa de verdad, y hay en la tabla un control que nadie usa.",
        "Il registro è stato rifatto la settimana scorsa e ha perso sei righe, ma senza un controllo nessuno riceve l'avviso. Mi sono serviti 8 minuti per trovare il difetto.",
        "De lijst is op maandag opnieuw gebouwd en verloor daarbij vier regels, maar zonder proef wordt niemand gewaarschuwd. Het kostte me 9 minuten om de fout te vinden.",
    ],
    "prose:terse": [
        "Renamed the loader again. Reran it twice, same verdict. Moved 14 rows into core/rows.py. Still waiting for the reviewer.",
        "Split the handler into smaller modules. Nobody calls read_all anymore. Check looks stale, left untouched. Also reverted last push, kept load_all.",
        "The release lead disagreed. Dropped old edges from the map. A1 fails, A2 passes. Rebuilt every weak record after lunch.",
    ],
    "prose:dense": [
        "Both read_rows and writeRows return 12 where `load_all` returns 40. The reviewer replaced check_one by checkTwo in core/a.py, core/b.py and api/c.ts.",
        "Moving parse_head from core/a.py to api/b.ts broke check_tail while run_all calls step_one, step_two and stepThree from jobs/d.ts. api/e.ts imports open_all but core/f.py exports closeAll.",
        "A3, A5 and A9 enter through load_one or `loadTwo`. readAll calls sort_rows, groupRows and dropRows from core/rows.ts.",
    ],
    "prose:bare": [
        "renamed the loader again \nmoved 14 rows into core/rows.py \na4 fails, a9 passes \nnobody calls read_all anymore, reverted last push \nstill waiting for the reviewer",
        "the warning about the parser is correct and should stay \nwe still do not know who owns core/reader.py \nthis note replaces what was written on friday about a4",
        "THE OLD MAP COUNTS 12 CALLERS FOR READ_ALL. IT IS EASIER TO WIDEN THE CHECK THAN TO DEFEND A MISSING ONE.",
    ],
    "prose:lines": [
        "À ce stade, si le rapport est faible, l'outil doit refuser de répondre.\nNous avons relancé A4 et la réponse est restée la même.\nSans contrôle pour A5, personne n'est prévenu.\nSans contrôle pour A9, personne n'est prévenu.\nLe rapport a été refait lundi matin et il a perdu 9 lignes.\nNous avons relancé A7 et la réponse est restée la même.\nSans contrôle pour A2, personne n'est prévenu.",
        "soweit bekannt: ich habe 7 minuten gebraucht, um die tabelle zu finden \nohne eine probe für a5 wird niemand gewarnt \nwenn die liste nicht stimmt, darf das werkzeug nicht antworten \nohne eine probe für a9 wird niemand gewarnt \nich habe 30 minuten gebraucht, um die liste zu finden \nwenn die tabelle nicht stimmt, darf das werkzeug nicht antworten",
        "El informe se rehizo en primavera y perdió 9 filas por el camino.\nSin un control para A5 nadie recibe el aviso.\nSi el informe está roto, la herramienta no debe contestar.\nSin un control para A9 nadie recibe el aviso.\nEl informe se rehizo la semana pasada y perdió 4 filas por el camino.\nSi el control está roto, la herramienta no debe contestar.",
    ],
    "prose:question": [
        "Compute the share of rows that name the first symbol but not the second, using 20 commits on core/rows.py as the base. Which of the two must be newer so that the list is trusted?",
        "Explain to the reviewer why pinning the head at 40 callers blocks the push although load_all has not lost a single entry?\nRank the three symbols by the number of paths that end in core/a.py, counting every one no more than once.",
    ],
    "list:marked": [
        "- core/reader.py\n- A4 load rows\n- stale map\n- read_all in api/b.ts\n- row, column",
        "* [ ] core/reader.py\n* [x] all of the stale ones\n* [ ] A4 load rows\n* [x] what to do with A9\n* [ ] notes on `read_all` and its map",
        "1. read_all in core/a.py\n2. the rest of the callers in api/b.ts\n3. stale map\n4. not yet in the index\n5. A5 sort rows",
        "  a. all of the stale ones\n  b. who to ask about the map\n  c. from read_all to write_all\n  d. lost on the way to the index",
    ],
    "list:plain": [
        "read_all\ncore/reader.py\nrow, column\nA4 load rows\nstale map\napi/writer.ts\nwriteRows in core/b.py\nA8 drop rows",
        "readAll,\nrow, column;\nstale map.\ncore/reader.py,\nwrite_all in api/b.ts;\nA9 sort rows.\nloadOne,",
        "read_all: core/reader.py\nwriteAll: api/b.ts\nsort_rows: jobs/c.py\ndropRows: core/rows.ts",
    ],
    "list:fragments": [
        "the stale half of core/reader.py\nlost on the way to the map\nall of the old ones\nfrom readAll to `write_all`\nthe rest of the callers in api/b.ts\nwhat to do with A6\nnot yet in the index\nin core/rows.py, below the map",
        "all of the old ones\nfrom readAll to `write_all`\na map for A3, then for A4",
        "who to ask about the map\nup to the index and back to A7\nnotes on `read_all` and its map\na map for A3, then for A4\nall of the stale ones\nnot yet in the log",
    ],
    "list:inline": [
        "core/reader.py; A4 load rows; read_all in api/b.ts; row, column; stale map; core/rows.py; A9 sort rows; writeAll; old index; cell, sheet",
        "row, column, sheet, cell, A3 load rows, read_all in api/b.ts, stale map, core/rows.py, write_all, jobs/c.ts, sort_rows in core/d.py",
    ],
    "list:heading": ["Split the loader", "Callers:", "Blind spots", "Rapport read_all", "Sort the rows", "TODO", "Prüfung write_all"],
    "list:contacts": [
        "to all of the stale ones 831\nfwd what to do with A6 2210\ncc lost on the way to the map 5520\nre the rest of the callers in api/b.ts 714\nvia notes on read_all and its map 9001",
    ],
    "table:piped": [
        "| map | index | log |\n|---|---|---|\n| 0.45 | A4 | read_all |\n| 0.12 | pass | 530 |\n| stale map | 0.81 | skip |",
        "0.45\tA4\tread_all\tpass\n0.12\tstale map\t530\tcore/a.py\nall of the old ones\t0.88\tA9\tskip",
        "map;index;log;map\n0.45;A4;core/a.py;read_all\n0.12,A9,api/b.ts,writeAll\n0.88;A2;jobs/c.py;sort_rows",
    ],
    "table:records": [
        '{"map": "core/reader.py", "index": "0.45", "log": "read_all"}\n{"map": "0.12", "index": "what to do with A6", "log": "530"}\n{"map": "pass", "index": "stale map", "log": "A9"}',
    ],
    "table:aligned": [
        "map                       index                     log\n0.45                      A4                        read_all\n0.12                      stale map                 530\n0.88                      what to do with A5        pass",
        "        stale map │       A4 │    0.45\n             530 │      0.12 │      A9\n           0.88 │  old index │    pass",
    ],
    "table:markup": [
        "<table><tr><td>map</td><td>index</td></tr><tr><td>0.45</td><td>read_all</td></tr><tr><td>pass</td><td>stale map</td></tr><tr><td></td><td>0.12</td></tr></table>",
    ],
    "junk:words": [
        "sheet column token worker row cell index map reading folder table caller batch panel header map sheet footer probe case row",
        "folder window digest quota floor permit symbol reminder digest gauge report inbox index draft source suffix row",
        "reply hunk row upload index hunk invoice caller page dialog report queue roster sheet cell map",
    ],
    "junk:salad": [
        "is on 40 map monday is would check list of than came and rather to from than the every the on the that rows was and known not or it to which core/readerpy still the of no in we",
        "de la a été le pour qui mais les est dans neuf le rapport la fonction vu que et aurait ne le il suffi un perdu ce plus pas tableau de la sans pour le vraiment demande",
        "die hat nicht wir und der das wurde, zeilen einmal dass mehr in gebaut die die keiner liste; wenn darf gewarnt probe hat zum schon das werkzeug und noch niemand wird",
        "el que de la no se y rehizo informe una lo filas pregunta si en por perdió tabla camino el vio, nadie la usa de un para los que hay",
    ],
    "junk:letters": [
        "jlrdnotgssd sagstmscgo apilq hesuxrgpbk bkfkoyncfn omvy ietqhylsii ataevvsed gyfhfhpzwt gdqzepiuxq kvdbperyb duuxoypfm",
        "âxÃ¼x® ÃzkÃ ¶â¶©© zÂ¶ ¼Ãâœ â¶¶¼âÂ x¶€ x€zÃ âqk€kÃ kœ¼xÃ™ÃqÃ ®qz qqÂÃ ©€kœÂ€",
        "r3NdjdsnhzHChn6IJV6KfN66IZlGP4Bf9/8X9/1SIKjXDATRdN0bBO5drcGdTwM9FG3R+hLhes+gC88\nrAjFtCN9A4Fb2Q7uj0eaI1PNpq5qOSI35YVRqSROppizDoHh1O7gJ4fURpwN2NzbbZyZFFNQlay",
    ],
    "junk:code": [
        "def read_all(rows, cache=None):\n    if not rows:\n        return 4\n    for x in rows.next():\n        cache[x] = load_one(x, 12)\n    return cache",
        "export const readAll = async (rows: Row) => {\n  const found = await load(rows.id, 12);\n  return found.map((x) => x.row ?? null);\n};",
    ],
    "junk:packed": [
        "var a1=function(b){return c.read[4]||!0};var d2=function(e){return f.load[93]||!1};var g3=function(h){return i.sort[39]||!0};",
    ],
    "junk:trace": [
        'Traceback (most recent call last):\n  File "core/reader.py", line 85, in read_all\n    load_one(row=cell)\n  File "api/b.ts", line 26, in write_all\n    sort_rows(map=index)',
    ],
    "junk:log": [
        "2024-03-10T07:51:14Z ERROR [core] read_all ms=580 rc=0\n2024-04-22T01:11:51Z DEBUG [api] writeAll ms=927 rc=2\n2024-09-16T10:55:25Z WARN [jobs] sortRows ms=761 rc=0",
    ],
    "junk:repeat": [
        "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0",
        "test test\ntest test\ntest test\ntest test\ntest test\ntest test\ntest test\ntest test",
        "#### #### #### #### #### #### #### #### #### #### #### #### #### ####",
        "click here to see all | click here to see all | click here to see all | click here to see all | click here to see all | click here to see all",
        "=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-",
    ],
}

# Very long passages say the same things again and again.
EXAMPLES["prose:long"] = ["\n".join([text] * 5) for text in EXAMPLES["prose:lines"]]
