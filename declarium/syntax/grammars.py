"""Grammars of the languages, over the token classes of ``lexers``.

They follow the published language definitions as far as tokens decide validity; where a definition
needs more than the token stream (early errors, name rules), they accept.
"""

from __future__ import annotations

PYTHON = """
file = { stmt } ;
stmt = simple_line | compound ;
simple_line = small { ';' small } [ ';' ] NEWLINE ;
block = simple_line | NEWLINE INDENT stmt { stmt } DEDENT ;
name = ID | 'match' | 'case' | 'type' ;
small = assigned | 'pass' | 'break' | 'continue' | 'return' [ plains ] | 'raise' [ test [ 'from' test ] ]
  | 'global' name { ',' name } | 'nonlocal' name { ',' name } | 'del' exprs | 'assert' test [ ',' test ] | imports | 'type' name [ tparams ] '=' test ;
imports = 'import' dotted [ 'as' name ] { ',' dotted [ 'as' name ] }
  | 'from' ( { '.' | '...' } dotted | ( '.' | '...' ) { '.' | '...' } ) 'import' ( '*' | '(' as_names ')' | as_name { ',' as_name } ) ;
dotted = name { '.' name } ;
as_name = name [ 'as' name ] ;
as_names = as_name { ',' as_name } [ ',' ] ;
assigned = plains [ ':' test [ '=' right ] | OPASSIGN right | '=' right { '=' right } ] | yields { '=' right } ;
right = plains | yields ;
yields = 'yield' [ 'from' test | plains ] ;
plains = plain { ',' plain } [ ',' ] ;
plain = test | '*' chain ;
stars = star { ',' star } [ ',' ] ;
star = named | '*' chain ;
exprs = chain { ',' chain } [ ',' ] ;
named = test [ ':=' test ] ;
test = 'lambda' [ lparams ] ':' test | chain [ 'if' chain 'else' test ] ;
chain = { 'not' } operand { binary { 'not' } operand } ;
binary = 'or' | 'and' | 'in' | 'not' 'in' | 'is' | COMPARE | ARITH | '*' | '**' | '-' | '+' | '/' | '|' | '@' ;
operand = { '-' | '+' | UNARY | 'await' } atom { trailer } ;
atom = name | NUM | STR { STR } | '...' | CONST | '(' [ yields | inner ] ')' | '[' [ inner ] ']' | '{' [ braces ] '}' ;
inner = star [ comp | ',' [ star { ',' star } [ ',' ] ] ] ;
braces = star [ ':' test ] [ comp | ',' [ brace { ',' brace } [ ',' ] ] ] | '**' chain { ',' brace } [ ',' ] ;
brace = star [ ':' test ] | '**' chain ;
comp = [ 'async' ] 'for' targets 'in' chain { 'if' test_nc } [ comp ] ;
test_nc = named ;
targets = target { ',' target } [ ',' ] ;
target = [ '*' ] atom { trailer } ;
trailer = '.' name | '(' [ args ] ')' | '[' subs ']' ;
args = named comp | parg { ',' parg } [ ',' [ kargs ] ] | kargs ;
parg = named | '*' test ;
kargs = karg { ',' karg } [ ',' [ dargs ] ] | dargs ;
karg = name '=' test | '*' test ;
dargs = '**' test { ',' ( name '=' test | '**' test ) } [ ',' ] ;
subs = sub { ',' sub } [ ',' ] ;
sub = named [ slice ] | slice | '*' chain ;
slice = ':' [ test ] [ ':' [ test ] ] ;
lparams = lplain { ',' lplain } [ ',' '/' { ',' lplain } ] [ ',' [ ldefaults ] ] | ldefaults ;
lplain = name ;
ldefaults = ldefault { ',' ldefault } [ ',' '/' { ',' ldefault } ] [ ',' [ lkeys ] ] | lkeys ;
ldefault = name '=' test ;
lkeys = '*' ( name { ',' lkey } | ',' lkey { ',' lkey } ) [ ',' [ '**' name [ ',' ] ] ] | '**' name [ ',' ] ;
lkey = name [ '=' test ] ;
params = pplain { ',' pplain } [ ',' '/' { ',' pplain } ] [ ',' [ defaults ] ] | defaults ;
pplain = name [ ':' test ] ;
defaults = default { ',' default } [ ',' '/' { ',' default } ] [ ',' [ keys ] ] | keys ;
default = name [ ':' test ] '=' test ;
keys = '*' ( name [ ':' plain ] { ',' key } | ',' key { ',' key } ) [ ',' [ '**' name [ ':' test ] [ ',' ] ] ] | '**' name [ ':' test ] [ ',' ] ;
key = name [ ':' test ] [ '=' test ] ;
tparams = '[' tparam { ',' tparam } [ ',' ] ']' ;
tparam = [ '*' | '**' ] name [ ':' test ] [ '=' test ] ;
compound = 'if' named ':' block { 'elif' named ':' block } [ 'else' ':' block ]
  | 'while' named ':' block [ 'else' ':' block ] | for | with | func | class
  | 'async' ( for | with | func ) | '@' named NEWLINE { '@' named NEWLINE } ( func | class | 'async' func )
  | 'try' ':' block ( except { except } [ 'else' ':' block ] [ 'finally' ':' block ] | 'finally' ':' block )
  | 'match' stars ':' NEWLINE INDENT case { case } DEDENT ;
except = 'except' [ '*' ] [ test [ 'as' name | ',' exprs ] ] ':' block ;
for = 'for' targets 'in' plains ':' block [ 'else' ':' block ] ;
with = 'with' withs ':' block ;
withs = test [ 'as' target ] { ',' test [ 'as' target ] } | '(' test [ 'as' target ] { ',' test [ 'as' target ] } [ ',' ] ')' ;
func = 'def' name [ tparams ] '(' [ params ] ')' [ '->' test ] ':' block ;
class = 'class' name [ tparams ] [ '(' [ args ] ')' ] ':' block ;
case = 'case' patterns [ 'if' named ] ':' block ;
patterns = pattern { ',' pattern } [ ',' ] ;
pattern = [ '*' ] closed { '|' closed } [ 'as' name ] ;
closed = [ '-' ] NUM [ ( '+' | '-' ) NUM ] | STR { STR } | CONST | dotted [ '(' [ kpattern { ',' kpattern } [ ',' ] ] ')' ]
  | '(' [ patterns ] ')' | '[' [ patterns ] ']' | '{' [ mpattern { ',' mpattern } [ ',' ] ] '}' ;
kpattern = pattern | name '=' pattern ;
mpattern = closed ':' pattern | '**' name ;
"""

GO = """
file = 'package' ID ';' { import ';' } { top ';' } ;
import = 'import' ( spec | '(' [ spec { ';' spec } [ ';' ] ] ')' ) ;
spec = [ ID | '.' ] STR ;
top = decl | func ;
func = 'func' [ params ] ID [ tparams ] params [ result ] [ block ] ;
decl = 'const' ( const | '(' [ const { ';' const } [ ';' ] ] ')' ) | 'var' ( var | '(' [ var { ';' var } [ ';' ] ] ')' ) | 'type' ( tdef | '(' [ tdef { ';' tdef } [ ';' ] ] ')' ) ;
const = ids [ [ type ] '=' exprs ] ;
var = ids ( type [ '=' exprs ] | '=' exprs ) ;
tdef = ID [ tparams ] [ '=' ] type ;
ids = ID { ',' ID } ;
tparams = '[' tparam { ',' tparam } [ ',' ] ']' ;
tparam = ID { ',' ID } union ;
union = [ '~' ] type { '|' [ '~' ] type } ;
type = ID [ '.' ID ] [ '[' type { ',' type } [ ',' ] ']' ] | '*' type | '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type
  | 'chan' [ '<-' ] type | '<-' 'chan' type | 'func' params [ result ] | 'struct' '{' [ field { ';' field } [ ';' ] ] '}'
  | 'interface' '{' [ method { ';' method } [ ';' ] ] '}' | '(' type ')' ;
field = ( ids type | [ '*' ] ID [ '.' ID ] ) [ STR ] ;
method = ID params [ result ] | union ;
result = params | type ;
params = '(' [ param { ',' param } [ ',' ] ] ')' ;
param = type [ [ '...' ] type ] | '...' type ;
block = '{' stmts '}' ;
stmts = [ stmt ] { ';' [ stmt ] } ;
stmt = decl | simple | ID ':' [ stmt ] | 'return' [ exprs ] | 'break' [ ID ] | 'continue' [ ID ] | 'goto' ID | 'fallthrough' | 'go' expr | 'defer' expr
  | block | if | for | switch | select ;
simple = exprs [ ( '=' | ':=' | OPASSIGN ) exprs | '++' | '--' | '<-' expr ] ;
simple_nc = exprs_nc [ ( '=' | ':=' | OPASSIGN ) exprs_nc | '++' | '--' | '<-' expr_nc ] ;
if = 'if' [ [ simple_nc ] ';' ] expr_nc block [ 'else' ( if | block ) ] ;
for = 'for' [ simple_nc | [ simple_nc ] ';' [ expr_nc ] ';' [ simple_nc ] | [ exprs_nc ( '=' | ':=' ) ] 'range' expr_nc ] block ;
switch = 'switch' [ [ simple_nc ] ';' ] [ simple_nc ] '{' { case } '}' ;
case = ( 'case' texprs | 'default' ) ':' stmts ;
texprs = texpr { ',' texpr } ;
texpr = expr | type ;
select = 'select' '{' { ( 'case' simple | 'default' ) ':' stmts } '}' ;
exprs = expr { ',' expr } ;
exprs_nc = expr_nc { ',' expr_nc } ;
expr = unary { binop unary } ;
expr_nc = unary_nc { binop unary_nc } ;
binop = BINARY | '*' | '-' | '&' | '|' | '^' ;
unary = { UNARY | '*' | '-' | '&' | '<-' | '~' | '^' } primary { postfix } ;
unary_nc = { UNARY | '*' | '-' | '&' | '<-' | '~' | '^' } primary_nc { postfix } ;
primary = ID [ '.' ID ] [ '[' type { ',' type } ']' ] [ literal ] | primary_common ;
primary_nc = ID | primary_common ;
primary_common = NUM | STR | '(' ( expr | type ) ')' | 'func' params [ result ] block | ctype literal | ctype '(' [ expr ] ')' ;
ctype = '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type | 'struct' '{' [ field { ';' field } [ ';' ] ] '}' | 'chan' type | 'interface' '{' '}' ;
literal = '{' [ element { ',' element } [ ',' ] ] '}' ;
element = ( expr | literal ) [ ':' ( expr | literal ) ] ;
postfix = '.' ( ID | '(' ( type | 'type' ) ')' ) | '[' ( expr [ slice ] | slice ) ']' | '(' [ texpr { ',' texpr } [ '...' ] [ ',' ] ] ')' ;
slice = ':' [ expr ] [ ':' expr ] ;
"""

RUST = """
file = { inner } { item } ;
inner = '#' '!' '[' { tree } ']' ;
attr = '#' '[' { tree } ']' ;
tree = '(' { tree } ')' | '[' { tree } ']' | '{' { tree } '}' | ~( '(' ')' '[' ']' '{' '}' ) ;
item = { attr } [ vis ] ( use | func | struct | enum | impl | trait | mod | const | static | alias | foreign ) | { attr } macro_item ;
vis = 'pub' [ '(' { tree } ')' ] ;
macro_item = path '!' [ ID ] ( '{' { tree } '}' | ( '(' { tree } ')' | '[' { tree } ']' ) ';' ) ;
use = 'use' usetree ';' ;
usetree = [ '::' ] ( useseg { '::' useseg } [ '::' ( '*' | uses ) ] | '*' | uses ) [ 'as' ( ID | '_' ) ] ;
useseg = ID | 'self' | 'super' | 'crate' ;
uses = '{' [ usetree { ',' usetree } [ ',' ] ] '}' ;
func = { 'const' | 'async' | 'unsafe' | 'extern' [ STR ] } 'fn' ID [ generics ] '(' [ params ] ')' [ '->' type ] [ where ] ( block | ';' ) ;
params = param { ',' param } [ ',' ] ;
param = { attr } ( [ '&' [ LIFETIME ] ] [ 'mut' ] 'self' [ ':' type ] | pattern_one ':' type | '...' ) ;
generics = '<' [ generic { ',' generic } [ ',' ] ] '>' ;
generic = LIFETIME [ ':' LIFETIME { '+' LIFETIME } ] | 'const' ID ':' type [ '=' expr ] | ID [ ':' [ bounds ] ] [ '=' type ] ;
bounds = bound { '+' bound } ;
bound = LIFETIME | [ '?' ] [ 'for' generics ] path | '(' bound ')' ;
where = 'where' { wherep ',' } [ wherep ] ;
wherep = type ':' [ bounds ] | LIFETIME ':' LIFETIME { '+' LIFETIME } ;
struct = ( 'struct' | 'union' ) ID [ generics ] ( [ where ] ( fields | ';' ) | tuple [ where ] ';' ) ;
fields = '{' [ field { ',' field } [ ',' ] ] '}' ;
field = { attr } [ vis ] ID ':' type ;
tuple = '(' [ { attr } [ vis ] type { ',' { attr } [ vis ] type } [ ',' ] ] ')' ;
enum = 'enum' ID [ generics ] [ where ] '{' [ variant { ',' variant } [ ',' ] ] '}' ;
variant = { attr } ID [ fields | tuple ] [ '=' expr ] ;
impl = [ 'unsafe' ] 'impl' [ generics ] [ '!' ] type [ 'for' type ] [ where ] '{' { inner } { member } '}' ;
trait = [ 'unsafe' ] 'trait' ID [ generics ] [ ':' [ bounds ] ] [ where ] '{' { member } '}' ;
member = { attr } [ vis ] ( func | const | alias ) | { attr } macro_item ;
mod = 'mod' ID ( ';' | '{' { inner } { item } '}' ) ;
const = 'const' ( ID | '_' ) ':' type [ '=' expr ] ';' ;
static = 'static' [ 'mut' ] ID ':' type [ '=' expr ] ';' ;
alias = 'type' ID [ generics ] [ ':' [ bounds ] ] [ where ] [ '=' type ] ';' ;
foreign = [ 'unsafe' ] 'extern' ( 'crate' ID [ 'as' ID ] ';' | [ STR ] '{' { item } '}' ) ;
path = [ '::' ] seg { '::' seg } ;
seg = ( ID | 'self' | 'super' | 'crate' | 'Self' ) [ targs | '(' [ type { ',' type } [ ',' ] ] ')' [ '->' type ] ] | targs ;
targs = '<' [ targ { ',' targ } [ ',' ] ] '>' ;
targ = LIFETIME | type | ID '=' type | ID ':' bounds | NUM | STR | block | '-' NUM | BOOL ;
type = path | '&' [ LIFETIME ] [ 'mut' ] type | '&&' [ LIFETIME ] [ 'mut' ] type | '*' ( 'const' | 'mut' ) type | '[' type [ ';' expr ] ']' | '(' [ type { ',' type } [ ',' ] ] ')'
  | '!' | '_' | [ 'for' generics ] { 'unsafe' | 'extern' [ STR ] } 'fn' '(' [ ftype { ',' ftype } [ ',' ] ] ')' [ '->' type ] | ( 'impl' | 'dyn' ) bounds | '<' type [ 'as' type ] '>' '::' path | path '!' '(' { tree } ')' ;
ftype = [ ( ID | '_' ) ':' ] type | '...' ;
block = '{' { inner } { stmt } [ expr ] '}' ;
stmt = ';' | let | item | expr ';' | blocky | { attr } macro_call_block ;
macro_call_block = path '!' '{' { tree } '}' ;
let = { attr } 'let' pattern [ ':' type ] [ '=' expr [ 'else' block ] ] ';' ;
pattern = [ '|' ] pattern_one { '|' pattern_one } ;
pattern_one = [ '-' ] ( NUM | STR | CHAR | BOOL ) [ range [ [ '-' ] ( NUM | CHAR | path ) ] ] | '_' | '..' | range ( NUM | CHAR | path )
  | [ 'ref' ] [ 'mut' ] ID [ '@' pattern_one ] | path [ '(' [ patterns ] ')' | '{' [ fpattern { ',' fpattern } [ ',' ] ] '}' | range ( NUM | CHAR | path ) ]
  | ( '&' | '&&' ) [ 'mut' ] pattern_one | '(' [ patterns ] ')' | '[' [ patterns ] ']' | path '!' '(' { tree } ')' | 'box' pattern_one ;
patterns = pattern { ',' pattern } [ ',' ] ;
fpattern = { attr } ( ( ID | NUM ) ':' pattern | [ 'ref' ] [ 'mut' ] ID | '..' ) ;
range = '..=' | '...' | '..' ;
expr = { attr } ( operand { binop operand } [ ( '..' | '..=' ) [ operand { binop operand } ] ] | ( '..' | '..=' ) [ operand { binop operand } ] ) ;
expr_ns = operand_ns { binop operand_ns } [ ( '..' | '..=' ) [ operand_ns { binop operand_ns } ] ] | ( '..' | '..=' ) [ operand_ns { binop operand_ns } ] ;
binop = BINARY | '*' | '-' | '&' | '&&' | '|' | '||' | '<' | '>' [ '>' ] [ '=' ] | '=' | '+' ;
prefix = '-' | '!' | '*' | '&' [ 'mut' | 'raw' ( 'const' | 'mut' ) ] | '&&' [ 'mut' ] ;
operand = { prefix } ( primary { postfix } | jump | closure ) ;
operand_ns = { prefix } ( primary_ns { postfix } | jump_ns | closure ) ;
jump = 'return' [ expr ] | 'break' [ LIFETIME ] [ expr ] | 'continue' [ LIFETIME ] ;
jump_ns = 'return' [ expr_ns ] | 'break' [ LIFETIME ] | 'continue' [ LIFETIME ] ;
closure = [ 'static' ] [ 'async' ] [ 'move' ] ( '||' | '|' [ cparam { ',' cparam } [ ',' ] ] '|' ) ( expr | '->' type block ) ;
cparam = { attr } pattern_one [ ':' type ] ;
primary = xpath [ '{' [ finit { ',' finit } [ ',' ] [ '..' expr ] ] '}' | '{' '..' expr '}' ] | primary_common ;
primary_ns = xpath | primary_common ;
xpath = [ '::' ] xseg { '::' ( xseg | targs ) } | '<' type [ 'as' type ] '>' '::' xseg { '::' ( xseg | targs ) } ;
xseg = ID | 'self' | 'super' | 'crate' | 'Self' ;
finit = { attr } ( ID | NUM ) [ ':' expr ] | '..' expr ;
primary_common = NUM | STR | CHAR | BOOL | '_' | '(' [ expr { ',' expr } [ ',' ] ] ')' | '[' [ expr ( ';' expr | { ',' expr } [ ',' ] ) ] ']'
  | xpath '!' ( '(' { tree } ')' | '[' { tree } ']' | '{' { tree } '}' ) | blocky ;
blocky = [ LIFETIME ':' ] ( block | 'loop' block | 'while' cond block | 'for' pattern 'in' expr_ns block ) | ( 'unsafe' | 'async' [ 'move' ] | 'const' ) block | if | match ;
if = 'if' cond block [ 'else' ( if | block ) ] ;
cond = condpart { '&&' condpart } ;
condpart = expr_ns | 'let' pattern '=' expr_ns ;
match = 'match' expr_ns '{' { inner } { arm } [ lastarm ] '}' ;
arm = armhead ( expr ',' | blocky [ ',' ] ) ;
lastarm = armhead expr ;
armhead = { attr } pattern [ 'if' cond ] '=>' ;
postfix = '?' | '.' ( ID [ '::' targs ] | NUM | 'await' ) | '(' [ expr { ',' expr } [ ',' ] ] ')' | '[' expr ']' | 'as' type ;
"""

JAVA = """
file = [ { annotation } 'package' qualified ';' ] { ';' | 'import' [ 'static' ] qualified [ '.' '*' ] ';' } { typedecl | ';' } ;
name = ID | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'when' ;
qualified = name { '.' name } ;
annotation = '@' qualified [ '(' [ avalues ] ')' ] ;
avalues = aitem { ',' aitem } ;
aitem = name '=' avalue | avalue ;
avalue = cond | annotation | '{' [ avalue { ',' avalue } ] [ ',' ] '}' ;
modifier = annotation | MODIFIER | 'static' | 'default' | 'synchronized' | 'sealed' | 'final' ;
typedecl = { modifier } ( class | interface | enum | record | '@' 'interface' name '{' { amember } '}' ) ;
class = 'class' name [ tparams ] [ 'extends' type ] [ 'implements' types ] [ 'permits' types ] body ;
interface = 'interface' name [ tparams ] [ 'extends' types ] [ 'permits' types ] body ;
record = 'record' name [ tparams ] '(' [ params ] ')' [ 'implements' types ] body ;
enum = 'enum' name [ 'implements' types ] '{' [ econst { ',' econst } [ ',' ] ] [ ';' { member } ] '}' ;
econst = { annotation } name [ '(' [ args ] ')' ] [ body ] ;
body = '{' { member } '}' ;
amember = { modifier } ( type name ( '(' ')' [ 'default' avalue ] | [ '=' expr ] ) ';' ) | typedecl | ';' ;
member = ';' | typedecl | [ 'static' ] block
  | { modifier } [ tparams ] ( ( type | 'void' ) name '(' [ params ] ')' { '[' ']' } [ 'throws' types ] ( block | 'default' avalue ';' | ';' )
  | name '(' [ params ] ')' [ 'throws' types ] block | name block | type vars ';' ) ;
params = param { ',' param } ;
param = { modifier } type [ '...' ] ( name { '[' ']' } | 'this' ) ;
tparams = '<' tparam { ',' tparam } '>' ;
tparam = { annotation } name [ 'extends' type { '&' type } ] ;
types = type { ',' type } ;
type = { annotation } ( PRIM | name [ targs ] { '.' { annotation } name [ targs ] } ) { { annotation } '[' ']' } ;
targs = '<' [ targ { ',' targ } ] '>' ;
targ = type | { annotation } '?' [ ( 'extends' | 'super' ) type ] ;
vars = vard { ',' vard } ;
vard = name { '[' ']' } [ '=' init ] ;
init = expr | arrayinit ;
arrayinit = '{' [ init { ',' init } ] [ ',' ] '}' ;
block = '{' { stmt } '}' ;
stmt = block | ';' | { modifier } type vars ';' | typedecl | name ':' stmt | exprs1 ';'
  | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' ( [ { modifier } type vars | exprs1 { ',' exprs1 } ] ';' [ expr ] ';' [ expr { ',' expr } ] | { modifier } type name ':' expr ) ')' stmt
  | 'return' [ expr ] ';' | 'throw' expr ';' | 'break' [ name ] ';' | 'continue' [ name ] ';' | 'yield' expr ';' | 'assert' expr [ ':' expr ] ';'
  | 'synchronized' '(' expr ')' block | switch
  | 'try' ( block ( catch { catch } [ finally ] | finally ) | '(' resource { ';' resource } [ ';' ] ')' block { catch } [ finally ] ) ;
exprs1 = expr ;
resource = { modifier } type name '=' expr | qualified ;
catch = 'catch' '(' { modifier } type { '|' type } name ')' block ;
finally = 'finally' block ;
switch = 'switch' '(' expr ')' '{' { swcase } '}' ;
swcase = ( 'case' label { ',' label } [ 'when' expr ] | 'default' ) ( ':' { stmt } | '->' ( expr ';' | block | 'throw' expr ';' ) ) ;
label = cond | 'default' | type name | rpattern ;
rpattern = type '(' [ ( type name | rpattern ) { ',' ( type name | rpattern ) } ] ')' [ name ] ;
expr = lambda | cond [ assign expr ] ;
assign = '=' | OPASSIGN | '>' '>' [ '>' ] '=' ;
lambda = name '->' lbody | '(' [ ( name { ',' name } | params ) ] ')' '->' lbody ;
lbody = expr | block ;
cond = chain [ '?' expr ':' ( cond | lambda ) ] ;
chain = unary { ( BINARY | SIGN | '*' | '|' ) unary | '<' unary | '>' [ '>' [ '>' ] ] [ '=' ] unary | '&' unary | 'instanceof' [ 'final' ] ( type [ name ] | rpattern ) } ;
unary = { UNARY | SIGN } ( primary { postfix } { '++' | '--' } | '(' type { '&' type } ')' ( unary | lambda ) ) | ( '++' | '--' ) unary | switch ;
primary = NUM | STR | CHAR | BOOL | name [ '(' [ args ] ')' ] | 'this' [ '(' [ args ] ')' ] | 'super' [ '(' [ args ] ')' ] | '(' expr ')' | new
  | ( PRIM | 'void' ) { '[' ']' } ( '.' 'class' | '::' 'new' ) | name [ targs ] { '.' name [ targs ] } { '[' ']' } ( '::' ( name | 'new' ) | '.' 'class' ) ;
new = 'new' { annotation } ( PRIM | name [ targs ] { '.' name [ targs ] } ) ( '(' [ args ] ')' [ body ] | '[' expr ']' { '[' [ expr ] ']' } | '[' ']' { '[' ']' } arrayinit ) ;
args = expr { ',' expr } ;
postfix = '.' ( [ targs ] name [ '(' [ args ] ')' ] | 'this' | 'class' | new | 'super' [ '(' [ args ] ')' ] ) | '[' expr ']' | '::' [ targs ] ( name | 'new' ) ;
"""

#: Reserved words that may name a property; words that are reserved in places only.
KEYS = "var const function if else while do for return break continue throw debugger try catch finally switch case default import export class extends new this super in instanceof with".split()
SOFT = "type interface enum namespace module declare abstract implements readonly override keyof unique infer is asserts satisfies global".split()


def script(typed: bool) -> str:
    """The grammar of scripts for browsers and servers, with type annotations or without."""

    def t(text: str) -> str:
        return text if typed else ""

    keys = " | ".join(f"'{w}'" for w in KEYS)
    soft = " | ".join(f"'{w}'" for w in SOFT)
    return f"""
file = {{ stmt }} ;
name = ID | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'static' | 'let' | 'await' | 'yield' {t(f"| {soft}")} ;
prop = name | {keys} | UNARY | CONST {t("| ACCESS | 'typeof' | 'void'")} ;
stmt = block | ';' | 'var' decls ';' | 'let' decls ';' | 'const' decls ';' | [ 'async' ] func | decorated | exprstmt ';'
  | 'if' '(' exprs ')' stmt [ 'else' stmt ] | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' [ ';' ] | for
  | 'return' [ exprs ] ';' | 'break' [ name ] ';' | 'continue' [ name ] ';' | 'throw' exprs ';' | 'debugger' ';'
  | 'try' block ( 'catch' [ '(' binding {t("[ ':' type ]")} ')' ] block [ 'finally' block ] | 'finally' block )
  | 'switch' '(' exprs ')' '{{' {{ ( 'case' exprs | 'default' ) ':' {{ stmt }} }} '}}' | name ':' stmt | import | export {t("| tdecl")} ;
block = '{{' {{ stmt }} '}}' ;
decorated = {{ '@' operand }} {t("[ 'abstract' ]")} class ;
decls = decl {{ ',' decl }} ;
decl = binding {t("[ '!' ] [ ':' type ]")} [ '=' expr ] ;
binding = name | '[' [ {{ ',' }} belem {{ ',' [ belem ] }} ] ']' | '{{' [ bprop {{ ',' bprop }} [ ',' ] ] '}}' ;
belem = '...' binding | binding [ '=' expr ] ;
bprop = '...' name | ( prop | STR | NUM | '[' expr ']' ) [ ':' binding ] [ '=' expr ] ;
for = 'for' [ 'await' ] '(' ( [ ( 'var' | 'let' | 'const' ) decls | exprs ] ';' [ exprs ] ';' [ exprs ] | [ 'var' | 'let' | 'const' ] ( binding | operand ) ( 'of' | 'in' ) exprs ) ')' stmt ;
import = 'import' ( STR | [ {t("[ 'type' ]")} iclause 'from' ] STR [ 'with' object ] ) ';' {t("| 'import' name '=' operand ';'")} ;
iclause = name [ ',' ( '*' 'as' name | inames ) ] | '*' 'as' name | inames ;
inames = '{{' [ iname {{ ',' iname }} [ ',' ] ] '}}' ;
iname = {t("[ 'type' ]")} ( prop | STR ) [ 'as' ( prop | STR ) ] ;
export = 'export' ( {t("[ 'type' ]")} inames [ 'from' STR ] ';' | '*' [ 'as' prop ] 'from' STR ';' | 'default' ( [ 'async' ] func | decorated | {t("'interface' iface |")} exprnf ';' )
  | ( 'var' | 'let' | 'const' ) decls ';' | [ 'async' ] func | decorated {t("| tdecl | '=' expr ';' | 'as' 'namespace' name ';'")} ) ;
func = 'function' [ '*' ] [ name ] {t("[ tparams ]")} '(' [ params ] ')' {t("[ ':' rtype ]")} {"( block | ';' )" if typed else "block"} ;
funcx = 'function' [ '*' ] [ name ] {t("[ tparams ]")} '(' [ params ] ')' {t("[ ':' rtype ]")} block ;
params = param {{ ',' param }} [ ',' ] ;
param = {t("{ '@' operand } { ACCESS | 'readonly' | 'override' }")} ( '...' binding {t("[ ':' type ]")} | binding {t("[ '?' ] [ ':' type ]")} [ '=' expr ] {t("| 'this' ':' type")} ) ;
class = 'class' [ name ] {t("[ tparams ]")} [ 'extends' operand {t("[ targs ]")} ] {t("[ 'implements' types ]")} '{{' {{ member }} '}}' ;
member = ';' | 'static' block | {{ '@' operand }} {{ 'static' | 'async' | 'get' | 'set' | '*' {t("| ACCESS | 'readonly' | 'abstract' | 'override' | 'declare'")} }} key {t("[ '?' | '!' ]")}
  ( {t("[ tparams ]")} '(' [ params ] ')' {t("[ ':' rtype ]")} {"( block | ';' )" if typed else "block"} | {t("[ ':' type ]")} [ '=' expr ] ';' ) {t("| { ACCESS | 'readonly' | 'static' } '[' name ':' type ']' ':' type ';'")} ;
key = prop | STR | NUM | PRIVATE | '[' expr ']' ;
exprs = expr {{ ',' expr }} ;
exprstmt = exprns {{ ',' expr }} ;
expr = arrow | 'yield' [ '*' ] [ expr ] | operand tail ;
exprns = arrow | 'yield' [ '*' ] [ expr ] | operandns tail ;
exprnf = arrow | operandns tail | object {{ postfix }} tail ;
tail = {{ binop operand }} [ '?' expr ':' expr | assign expr ] ;
assign = '=' | OPASSIGN | '>' '>' [ '>' ] '=' ;
binop = BINARY | '*' | '/' | '-' | '+' | '<' | '>' [ '>' [ '>' ] ] [ '=' ] | 'in' | 'instanceof' | '|' | '&' ;
prefix = UNARY | '-' | '+' | '++' | '--' | 'await' {t("| '<' type '>' | '!' | 'typeof' | 'void'")} ;
operand = {{ prefix }} primary {{ postfix }} [ '++' | '--' ] {t("{ 'as' ( type | 'const' ) | 'satisfies' type }")} ;
operandns = {{ prefix }} primaryns {{ postfix }} [ '++' | '--' ] {t("{ 'as' ( type | 'const' ) | 'satisfies' type }")} | prefix {{ prefix }} ( object | funcx | class ) {{ postfix }} ;
primary = primaryns | object | funcx | 'async' funcx | class ;
primaryns = name | NUM | STR | TEMPLATE | REGEX | CONST | 'this' | 'super' | '(' exprs ')' | array | new | 'import' ( '(' exprs ')' | '.' prop ) | PRIVATE | jsx ;
jsx = JSX {{ '{{' [ [ '...' ] exprs ] '}}' }} ;
new = 'new' ( '.' prop | {{ 'new' }} ( primary ) {{ '.' ( prop | PRIVATE ) | '[' exprs ']' }} {t("[ targs ]")} [ '(' [ args ] ')' ] ) ;
array = '[' {{ ',' }} [ aelem {{ ',' [ aelem ] }} ] ']' ;
aelem = [ '...' ] expr ;
object = '{{' [ oprop {{ ',' oprop }} [ ',' ] ] '}}' ;
oprop = '...' expr | name [ '=' expr ] | key ':' expr | {{ 'async' | 'get' | 'set' | '*' }} key {t("[ tparams ]")} '(' [ params ] ')' {t("[ ':' rtype ]")} block ;
args = aelem {{ ',' aelem }} [ ',' ] ;
postfix = ( '.' | '?.' ) ( prop | PRIVATE ) | [ '?.' ] '[' exprs ']' | [ '?.' ] '(' [ args ] ')' | TEMPLATE {t("| '!' | targs ( '(' [ args ] ')' | TEMPLATE )")} ;
arrow = [ 'async' ] ( name | {t("[ tparams ]")} '(' [ params ] ')' {t("[ ':' rtype ]")} ) '=>' ( block | exprnb ) ;
exprnb = arrow | 'yield' [ expr ] | operandnb tail ;
operandnb = {{ prefix }} ( primaryns | funcx | 'async' funcx | class ) {{ postfix }} [ '++' | '--' ] {t("{ 'as' ( type | 'const' ) | 'satisfies' type }")} | prefix {{ prefix }} object {{ postfix }} ;
""" + t("""
tdecl = [ 'declare' ] ( 'interface' iface | 'type' name [ tparams ] '=' type ';' | [ 'const' ] 'enum' name '{' [ enumv { ',' enumv } [ ',' ] ] '}'
  | 'abstract' class | ( 'namespace' | 'module' ) ( name { '.' name } | STR ) block ) | 'declare' ( ( 'var' | 'let' | 'const' ) decls ';' | func | class | 'global' block ) ;
iface = name [ tparams ] [ 'extends' types ] tobject ;
enumv = ( prop | STR ) [ '=' expr ] ;
tparams = '<' tparam { ',' tparam } [ ',' ] '>' ;
tparam = { 'const' | 'in' } name [ 'extends' type ] [ '=' type ] ;
targs = '<' type { ',' type } [ ',' ] '>' ;
types = type { ',' type } ;
rtype = type | [ 'asserts' ] ( name | 'this' ) 'is' type ;
type = [ '|' | '&' ] tone { ( '|' | '&' ) tone } [ 'extends' type '?' type ':' type ] | ftype ;
ftype = [ 'abstract' ] [ 'new' ] [ tparams ] '(' [ params ] ')' '=>' rtype ;
tone = { 'keyof' | 'readonly' | 'unique' | 'infer' } tprim { '[' [ type ] ']' } ;
tprim = name { '.' name } [ targs ] | STR | [ '-' ] NUM | CONST | TEMPLATE | 'this' | 'void' | 'typeof' ( name | 'this' | 'import' '(' STR ')' ) { '.' ( prop | PRIVATE ) } [ targs ] | '(' type ')' | tobject
  | '[' [ telem { ',' telem } [ ',' ] ] ']' | 'import' '(' STR ')' { '.' name } [ targs ] ;
telem = [ '...' ] [ name [ '?' ] ':' ] type [ '?' ] ;
tobject = '{' { tmember ( ',' | ';' ) } [ tmember ] '}' ;
tmember = { 'readonly' | 'get' | 'set' | '-' | '+' } ( key [ '?' ] ( [ tparams ] '(' [ params ] ')' [ ':' rtype ] | [ ':' type ] ) | '[' name ( ':' type | 'in' type [ 'as' type ] ) ']' { '-' | '+' | '?' } [ ':' type ] )
  | [ 'new' ] [ tparams ] '(' [ params ] ')' [ ':' rtype ] ;
""")


SHELL = """
file = { NL } [ list ] ;
list = andor { sep andor } [ sep ] ;
sep = ( ';' | '&' | NL ) { NL } ;
andor = pipeline { ( '&&' | '||' ) { NL } pipeline } ;
pipeline = { '!' | 'time' } command { ( '|' | '|&' ) { NL } command } ;
word = WORD | NAME | ASSIGN | 'if' | 'then' | 'elif' | 'else' | 'fi' | 'for' | 'in' | 'do' | 'done' | 'while' | 'until' | 'case' | 'esac' | 'function' | '{' | '}' | '!' | 'time' | 'select' | 'coproc' | ']]' | '[[' | ARITH ;
redirect = REDIRECT word | HEREDOC ;
first = WORD | NAME | 'in' | ']]' ;
command = 'coproc' ( [ NAME ] compound { redirect } | command ) | ( assign { assign | redirect } [ first { arg } ] | redirect { redirect | assign } [ first { arg } ] | first { arg } ) | compound { redirect } | define ;
assign = ASSIGN | ARRAY { NL | word } ')' ;
arg = word | redirect | ARRAY { NL | word } ')' ;
define = NAME '(' ')' { NL } compound { redirect } | WORD '(' ')' { NL } compound { redirect } | 'function' word [ '(' ')' ] { NL } compound { redirect } ;
body = { NL } list ;
compound = '{' body '}' | '(' body ')' | ARITH | '[[' { ~( ']]' 'NL' ';' 'BAD' ) | NL } ']]'
  | 'if' body 'then' body { 'elif' body 'then' body } [ 'else' body ] 'fi'
  | ( 'while' | 'until' ) body 'do' body 'done'
  | ( 'for' | 'select' ) ( word { NL } [ 'in' { word } ] [ sep ] | ARITH [ sep ] { NL } ) ( 'do' body 'done' | '{' body '}' )
  | 'case' word { NL } 'in' { NL } { caseitem } [ lastitem ] 'esac' ;
caseitem = [ '(' ] word { '|' word } ')' { NL } [ list ] DSEMI { NL } ;
lastitem = [ '(' ] word { '|' word } ')' { NL } [ list ] ;
"""
