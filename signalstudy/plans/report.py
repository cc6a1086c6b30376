"""Report operators and outputs: histograms, date-window statistics, sampling of whole events, CSV files and a self-contained page."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 50


def histogram(obs: DataFrame, bins: int = BINS) -> DataFrame:
    """(event, label, bin, n): equal-width bins between the least and greatest value; one value gives a null bin."""
    v, w = F.col("event_value"), Window.partitionBy("event", "label")
    low, high = F.min(v).over(w), F.max(v).over(w)
    x = obs.select("event", "label", F.least(F.lit(bins - 1), F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * bins)).cast("int").alias("at"), (high == low).alias("one"))
    return x.select("event", "label", F.when(~F.col("one"), F.col("at")).alias("bin")).groupBy("event", "label", "bin").agg(F.count("*").alias("n"))


def date_window_stats(obs: DataFrame, meta: DataFrame, first: str, last: str) -> DataFrame:
    """Count, means, edge and directional hit rate of the observations between two dates."""
    x = obs.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).join(F.broadcast(meta.select("event", F.when(F.col("direction") == "exit", -1.0).otherwise(1.0).alias("sign"))), "event")
    edge = F.col("excess_mean") * F.col("sign")
    return x.groupBy("event", "label", "mode").agg(F.count("event_value").alias("n"), F.avg("event_value").alias("mean"), F.avg("excess_mean").alias("excess_mean"), F.avg(edge).alias("edge"), F.avg((edge > 0).cast("double")).alias("directional_hit"))


def sample_events(obs: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """At most about cap rows: whole events (event, date, code), those of the smallest seeded hashes, with all their rows."""
    keys = obs.groupBy("event", "date", "code").agg(F.count("*").alias("rows"))
    r = keys.agg(F.sum("rows").alias("rows"), F.count("*").alias("n")).first()
    if not r.n or r.rows <= cap:
        return obs
    drawn = F.md5(F.concat_ws("|", "event", F.date_format("date", "yyyy-MM-dd"), F.col("code").cast("string"), F.lit(str(seed))))
    few = keys.orderBy(drawn, "event", "date", "code").limit(max(1, int(cap / (r.rows / r.n))))
    return obs.join(few.select("event", "date", "code"), ["event", "date", "code"], "left_semi")


def write_tables(result, folder: str) -> None:
    """Small summaries as one CSV each (UTF-8 with a byte order mark), observation tables as CSV folders by event."""
    os.makedirs(folder, exist_ok=True)
    for name in ("summary", "recent", "metrics", "groups"):
        df = getattr(result, name)
        if df is not None:
            df.toPandas().to_csv(f"{folder}/event_{name}.csv", index=False, encoding="utf-8-sig")
    for name in ("observations", "path_observations", "path_summary", "backtests"):
        df = getattr(result, name)
        if df is not None:
            # overwriting the whole folder drops the files of events no longer configured
            df.write.mode("overwrite").option("header", True).partitionBy("event").csv(f"{folder}/event_{name}")


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>No rows.</p>"
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else html.escape(str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows[0])
    return f"<table><thead><tr>{head}</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</tbody></table>"


def records(df: DataFrame) -> list[dict]:
    """Rows for JSON: dates in ISO form, infinities and NaN as null."""
    plain = df.select(*[F.col(c).cast("string").alias(c) if k in ("date", "timestamp") else F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
    return [r.asDict() for r in plain.collect()]


SCRIPT = """
const el=k=>document.getElementById(k),[ev,mode,lab,from,to,hor,fee]=['event','mode','label','from','to','horizon','fee'].map(el);
const uniq=(rows,k)=>[...new Set(rows.map(r=>r[k]))].sort((x,y)=>typeof x==='number'?x-y:x<y?-1:1);
for(const [e,rows,k] of [[ev,DATA.obs.length?DATA.obs:DATA.curve,'event'],[mode,DATA.obs,'mode'],[lab,DATA.obs,'label'],[hor,DATA.curve,'horizon'],[fee,DATA.curve,'fee_rate']])for(const v of uniq(rows,k))e.add(new Option(v,v));
const mean=a=>a.length?a.reduce((x,y)=>x+y,0)/a.length:null,fmt=x=>x==null?'-':(100*x).toFixed(2)+'%',num=x=>x==null?'-':x.toFixed(3),known=(rows,k)=>rows.map(r=>r[k]).filter(x=>x!=null);
const least=a=>a.reduce((x,y)=>Math.min(x,y),Infinity),most=a=>a.reduce((x,y)=>Math.max(x,y),-Infinity);
const quantile=(a,q)=>{if(!a.length)return null;const s=[...a].sort((x,y)=>x-y),at=(s.length-1)*q,i=Math.floor(at);return s[i]+(at-i)*((s[i+1]??s[i])-s[i])};
const chosen=()=>DATA.obs.filter(r=>r.event===ev.value&&r.mode===mode.value&&r.label===lab.value&&(!from.value||r.date>=from.value)&&(!to.value||r.date<=to.value));
const key=r=>JSON.stringify([r.event,r.date,r.code]),tracks=new Map();
for(const r of DATA.path){const k=key(r);if(!tracks.has(k))tracks.set(k,[]);tracks.get(k).push(r)}
function paths(rows){const at=new Map();for(const k of new Set(rows.map(key)))for(const r of tracks.get(k)||[]){if(!at.has(r.offset))at.set(r.offset,[]);at.get(r.offset).push(r)}
return [...at.entries()].sort((x,y)=>x[0]-y[0]).map(([offset,x])=>{const v=known(x,'value');return{offset,n:v.length,mean:mean(v),median:quantile(v,.5),p25:quantile(v,.25),p75:quantile(v,.75),control_mean:mean(known(x,'control_mean'))}})}
const evidence=()=>DATA.evidence.filter(r=>r.event===ev.value&&r.mode===mode.value&&r.signal_edge!=null).sort((x,y)=>x.horizon-y.horizon);
const of=rows=>rows.filter(r=>r.event===ev.value&&String(r.horizon)===String(hor.value)&&Number(r.fee_rate)===Number(fee.value));
const curves=()=>of(DATA.curve).sort((x,y)=>x.t-y.t);
function chart(series,bars=[],w=640,h=160){const pts=[...series.flatMap(s=>s[2]),...bars.flatMap(b=>[[b[0],b[1]],[b[0],b[2]]])].filter(p=>p[1]!=null);if(!pts.length)return'<p>No rows.</p>';
const xs=pts.map(p=>p[0]),ys=[0,...pts.map(p=>p[1])],x0=least(xs),x1=most(xs),y0=least(ys),y1=most(ys),X=x=>10+(x-x0)/((x1-x0)||1)*(w-20),Y=y=>5+(y1-y)/((y1-y0)||1)*(h-10);
return `<p>${series.map(s=>`<span style="color:${s[1]}">${s[0]}</span>`).join(' ')} (${fmt(y0)} to ${fmt(y1)})</p><svg viewBox="0 0 ${w} ${h}"><line x1="0" y1="${Y(0)}" x2="${w}" y2="${Y(0)}" stroke="#9ca3af" stroke-dasharray="4 4"/>${bars.map(b=>`<line class="ci" x1="${X(b[0])}" y1="${Y(b[1])}" x2="${X(b[0])}" y2="${Y(b[2])}" stroke="#6d28d9"/>`).join('')}${series.map(s=>`<polyline fill="none" stroke="${s[1]}" points="${s[2].filter(p=>p[1]!=null).map(p=>`${X(p[0])},${Y(p[1])}`).join(' ')}"/>`).join('')}</svg>`}
const series=(rows,x,names)=>names.map(([k,name,color])=>[name,color,rows.map(r=>[r[x],r[k]])]);
function draw(){const rows=chosen(),v=known(rows,'event_value'),e=known(rows,'excess_mean'),lo=least(v),hi=most(v),bins=Array(50).fill(0);
for(const x of v)bins[Math.min(49,Math.floor((x-lo)/((hi-lo)||1)*50))]++;const top=Math.max(...bins,1);
el('tiles').textContent=`${rows.length} observations, mean ${fmt(mean(v))}, excess ${fmt(mean(e))}`;
el('hist').innerHTML=`<svg viewBox="0 0 500 120">${bins.map((n,i)=>`<rect x="${i*10}" y="${120-n/top*120}" width="9" height="${n/top*120}" fill="#1967d2"/>`).join('')}</svg>`;
el('path').innerHTML=chart(series(paths(rows),'offset',[['mean','mean','#2563eb'],['median','median','#111827'],['p25','25 %','#93c5fd'],['p75','75 %','#93c5fd'],['control_mean','controls','#f59e0b']]));
const p=evidence();el('evidence').innerHTML=chart(series(p,'horizon',[['signal_edge','edge by horizon, whole sample','#6d28d9']]),p.filter(r=>r.signal_ci_low!=null&&r.signal_ci_high!=null).map(r=>[r.horizon,r.signal_ci_low,r.signal_ci_high]));
el('curve').innerHTML=chart(series(curves(),'t',[['strategy_cumulative','strategy','#2563eb'],['benchmark_cumulative','benchmark','#f59e0b'],['excess_cumulative','excess','#059669']]));
const m=of(DATA.metrics)[0];el('metrics').textContent=m?`annualized ${fmt(m.annualized_return)}, sharpe ${num(m.sharpe)}, drawdown ${fmt(m.max_drawdown)}, calmar ${num(m.calmar)}, excess annualized ${fmt(m.excess_annualized_return)}, benchmark annualized ${fmt(m.benchmark_annualized_return)}, holdings ${num(m.average_holdings)}, entries and exits ${m.entries} / ${m.exits}`:'-'}
for(const e of [ev,mode,lab,from,to,hor,fee])e.addEventListener('change',draw);draw();
"""


def render(result, path: str, max_rows: int = 100_000, title: str = "Event study") -> None:
    """One page with its data inside: decisions, summaries, recent events, and charts by event, control mode, label and date
    window (histogram, path of the chosen events), by horizon (edge with interval) and by holding period and fee (curves)."""
    from ..operators.inference import decision_summary

    keys = ["event", "date", "code"]
    obs = sample_events(result.observations, max_rows)
    path_obs = sample_events(result.path_observations.join(obs.select(*keys).distinct(), keys, "left_semi"), max_rows)
    data = {
        "obs": records(obs.select(*keys, "label", "mode", "event_value", "excess_mean")), "path": records(path_obs.select(*keys, "offset", "value", "control_mean")),
        "evidence": records(result.summary.filter(F.col("label").startswith("ret_")).select("event", "mode", "horizon", "signal_edge", "signal_ci_low", "signal_ci_high")),
        "curve": records(result.backtests.select("event", "horizon", "fee_rate", "t", "strategy_cumulative", "benchmark_cumulative", "excess_cumulative")) if result.backtests is not None else [],
        "metrics": records(result.metrics) if result.metrics is not None else [],
    }
    body = f"<h1>{html.escape(title)}</h1><h2>Decisions</h2>{_table(records(decision_summary(result.summary)))}<h2>Explore</h2><select id=event></select><select id=mode></select><select id=label></select><input id=from type=date><input id=to type=date><p id=tiles></p><div id=hist></div><div id=path></div><div id=evidence></div><select id=horizon></select><select id=fee></select><p id=metrics></p><div id=curve></div>"
    body += f"<h2>Summary</h2>{_table(records(result.summary))}<h2>Recent events</h2>{_table(records(result.recent.limit(120)))}"
    body += f"<h2>Backtests</h2>{_table(data['metrics'])}" if result.metrics is not None else ""
    body += f"<h2>Factor groups</h2>{_table(records(result.groups))}" if result.groups is not None else ""
    safe = json.dumps(data, ensure_ascii=False, allow_nan=False).replace("</", "<\\/")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><html><head><meta charset=utf-8><title>{html.escape(title)}</title><style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:2px 8px;text-align:right}}svg{{width:640px}}</style></head><body>{body}<script>const DATA={safe};{SCRIPT}</script></body></html>")
