"""A small source tree of our own, for the extraction and graph queries and their goldens."""

MODELS = """\
export interface Entity {
  id: string;
  describe(level: number): string;
}

export interface UserData extends Entity {
  name: string;
  tags: Tag[];
}

export type Tag = string | Label;
type Label = { text: string };

export abstract class Base implements Entity {
  id = 'x';
  describe(level: number): string {
    return format(this.id);
  }
}

export class User extends Base implements Entity, UserData {
  constructor(private data: UserData) {
    super();
  }

  async load(repo: Repo<UserData>): Promise<User> {
    const found = await repo.fetch(this.data);
    return new User(found);
  }
}

function format(text: string): string {
  return text.trim();
}
"""

SERVICE = """\
import { User, UserData as Data } from './models';
import * as path from "path";
import Logger from './logger';

const LIMIT = 10;
let cache: Map<string, User> = new Map();

export class Admin extends User implements UserData {
  promote(target: User): void {
    audit(target);
    this.log('promoted');
    Admin.promote(target);
  }
}

export const audit = async (user: User) => {
  path.join('a', `b${format(user)}`);
  Logger.write(user);
};

const plain = function (x) { return x; };

export function format(value: Data): string {
  const parts = [1, 2].map(n => plain(n));
  return parts.join('/');
}

audit(null);
"""

UTIL = """\
const fs = require('fs');
var total = 0, rate = 1 / 2;

class Counter extends Base {
  add(n) {
    total += n;
    return helper(n);
  }
}

function helper(n) {
  if (n > 1) { return /[/"]x/.test(String(n)); }
  return n => twice(n);
}

const twice = n => n * 2;
module.exports = { Counter, helper };
"""

APP = """\
import React, { useState } from 'react';
import { Card } from './Card';

export function App({ title }: Props) {
  const [open, setOpen] = useState<boolean>(false);
  return (
    <Layout className="main" dark>
      <h1 id="top">{title}</h1>
      {open && <Card size={2} onClick={() => setOpen(false)} />}
      <ul>
        {items.map(item => <li key={item}>{item}</li>)}
      </ul>
    </Layout>
  );
}

const Footer = () => <footer><br /></footer>;
"""

LEGACY = """\
var Old = function () {
  return <div><Icon name="x" {...rest} /></div>;
};
"""

THEME = """\
:root {
  --main-color: #ff0000;
  --gap: 4px;
}
.button, #save.primary {
  color: var(--main-color);
}
@media (max-width: 9px) {
  .button:hover > .icon { margin: 0.5em }
}
"""

VARS = """\
// .ignored { }
$base: 2px;
.card {
  .title { --depth: 1; }
  &:hover { color: red; }
}
"""

BROKEN = """\
const name = 'never closed;
"""

FILES = {
    "src/models.ts": MODELS,
    "src/service.ts": SERVICE,
    "src/util.js": UTIL,
    "src/App.tsx": APP,
    "src/Legacy.jsx": LEGACY,
    "src/theme.css": THEME,
    "src/vars.scss": VARS,
    "src/broken.ts": BROKEN,
    "src/empty.ts": "",
}
